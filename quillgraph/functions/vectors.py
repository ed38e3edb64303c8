"""Vector arithmetic on array columns, and stable ids."""

from __future__ import annotations

import hashlib
import struct
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.udf import lazy_udf


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector counts as of length one."""
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na == 0, F.lit(1.0)).otherwise(na) * F.when(nb == 0, F.lit(1.0)).otherwise(nb))


def uuid5(namespace: str, key: Column) -> Column:
    """Version 5 UUID text, from SHA-1 without Python."""
    ns = uuid.UUID(namespace).hex
    h = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(key, "UTF-8")))
    third = F.concat(F.lit("5"), F.substring(h, 14, 3))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), third, F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


@lazy_udf("string")
def digest(v: pd.Series) -> pd.Series:
    """SHA-256 of the values as big-endian doubles; -0.0 counts as 0.0 and all NaN are one."""
    def one(x):
        if x is None:
            return None
        vals = [float("nan") if y != y else float(y) + 0.0 for y in x]
        return hashlib.sha256(struct.pack(f">{len(vals)}d", *vals)).hexdigest()

    return v.map(one)
