"""Canonical lexeme codes: a letter, at least four digits, an optional upper-case suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero_padded(digits: Column) -> Column:
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))


def canonical(raw: Column, lang: Column | None = None) -> Column:
    """struct(canonical, suffix); both null where the code can't be read (blank, unknown form, or no letter and no lang).

    Braces around the code and what stands before its first slash are dropped. ``lang`` is ``hb`` or ``gk`` and gives
    the letter of codes that have none.
    """
    s = F.trim(raw)
    s = F.when(s.rlike("^\\{.*\\}$"), F.trim(F.regexp_replace(s, "^\\{|\\}$", ""))).otherwise(s)
    after = F.regexp_extract(s, "^[^/]*/(.+)$", 1)
    s = F.when(after != "", after).otherwise(s)
    letter = F.upper(F.regexp_extract(s, "^([HGhg])\\d", 1))
    by_lang = F.when(lang == "hb", "H").when(lang == "gk", "G") if lang is not None else F.lit(None).cast("string")
    prefixed, bare = s.rlike("^[HGhg]\\d+[A-Za-z]?$"), s.rlike("^\\d+ ?[A-Za-z]?$")
    head = F.when(prefixed, letter).when(bare & ~s.rlike(" $"), by_lang)
    digits, suffix = F.regexp_extract(s, "(\\d+)", 1), F.upper(F.regexp_extract(s, "\\d ?([A-Za-z])$", 1))
    suffix = F.when(suffix != "", suffix)
    return F.struct(
        F.when(head.isNotNull(), F.concat(head, _zero_padded(digits), F.coalesce(suffix, F.lit("")))).alias("canonical"),
        F.when(head.isNotNull(), suffix).alias("suffix"),
    )


def without_sense(raw: Column) -> Column:
    """The code without a sense letter at its end, canonical where that can be read, else as given."""
    base = F.regexp_replace(F.trim(raw), "(?<=\\d)[A-Za-z]+$", "")
    return F.coalesce(canonical(base)["canonical"], raw)


def report_order(code: Column) -> list[Column]:
    """Sort keys: H before G, then by number, then by suffix."""
    return [F.when(code.startswith("H"), 0).otherwise(1), F.regexp_extract(code, "(\\d+)", 1).cast("long"), code]
