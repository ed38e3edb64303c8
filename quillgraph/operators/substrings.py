"""Which of many terms stand anywhere in a text: an Aho-Corasick automaton of the terms runs over each text once.

A block of terms is collected, shipped and made to an automaton once in a worker; more terms than a block holds take further passes
over the texts, so any number gives the whole result. Texts stay where they are; only hits are moved.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms in one automaton: bounds what is collected and a worker's memory.
BLOCK_TERMS = 100_000
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(terms, key: str) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of terms; a worker keeps the last one, by a key of its own."""
    if key not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for t in terms.value:
            made.add_word(t, t)
        made.make_automaton()
        _BUILT[key] = made
    return _BUILT[key]


def _hits(terms):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(terms, key)
        for batch in batches:
            row, term = [], []
            for k, text in enumerate(batch.column("__text").to_pylist()):
                got = sorted({t for _, t in found.iter(text)}) if text else []
                row += [k] * len(got)
                term += got
            own = batch.select([n for n in batch.schema.names if n != "__text"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(term, pa.string())], names=[*own.schema.names, "term"])

    return run


def contained(texts: DataFrame, terms: DataFrame, text: str = "text", block_terms: int | None = None) -> DataFrame:
    """``texts`` without ``text``, once for each distinct term (column ``term`` of ``terms``) that stands in it, with ``term``.

    Case counts: lower both before, if it shouldn't. Null terms stand nowhere, an empty term in every text that isn't null.
    """
    spark, most = texts.sparkSession, block_terms or BLOCK_TERMS
    distinct = terms.select(F.col("term").cast("string").alias("term")).where("term IS NOT NULL").distinct()
    own = [c for c in texts.columns if c != text]
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in own)
    rows = texts.select(*own, F.col(text).cast("string").alias("__text"))
    n = distinct.count()
    blocks = max(1, -(-n // most))
    out = []
    for k in range(blocks):
        some = distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        words = sorted(r["term"] for r in some.collect())  # about BLOCK_TERMS
        if full := [w for w in words if w]:
            out.append(rows.mapInArrow(_hits(spark.sparkContext.broadcast(full)), f"{fields}, term string"))
        if "" in words:
            out.append(rows.where(F.col("__text").isNotNull()).drop("__text").withColumn("term", F.lit("")))
    return reduce(DataFrame.unionByName, out) if out else rows.drop("__text").withColumn("term", F.lit("")).limit(0)
