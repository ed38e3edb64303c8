"""Verification: predicates, invariants, tolerances, snapshots and vector quality."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.vectors import cosine

#: What it takes for a value of each kind not to be empty.
FILLED: dict[str, Callable[[Column], Column]] = {
    "string": lambda c: F.coalesce(F.trim(c) != "", F.lit(False)),
    "float": lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)),
    "int": lambda c: c.isNotNull(),
    "list": lambda c: F.coalesce(F.size(c) > 0, F.lit(False)),
    "bool": lambda c: c.isNotNull(),
}


def filled(kind: str, c: Column) -> Column:
    if kind not in FILLED:
        raise KeyError(f"no predicate for type {kind!r}")
    return FILLED[kind](c)


def check(name: str, observed: DataFrame, ok: Column, expected: str) -> DataFrame:
    """(name, ok, observed, expected) of a one-row, one-column DataFrame; ``ok`` reads column ``observed``."""
    return observed.toDF("observed").select(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), F.col("observed").cast("string").alias("observed"), F.lit(expected).alias("expected"))


def adapter_checks(nodes: DataFrame, required: dict[str, str], lemma: str, edges: DataFrame, edge_floor: int) -> DataFrame:
    """What catches an adapter that emits nothing, blanks, one value for all, or duplicates."""
    out = [
        check("rows", nodes.agg(F.count(F.lit(1))), F.col("observed") > 0, "> 0"),
        check("distinct lemmas", nodes.agg(F.countDistinct(lemma)), F.col("observed") >= 2, ">= 2"),
        check("unique ids", nodes.agg(F.count("id") - F.countDistinct("id")), F.col("observed") == 0, "0"),
        check("edges", edges.agg(F.count(F.lit(1))), F.col("observed") >= edge_floor, f">= {edge_floor}"),
    ]
    for c, kind in required.items():
        out.append(check(f"{c} filled", nodes.agg(F.count_if(~filled(kind, F.col(c)))), F.col("observed") == 0, "0"))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def band(expected: Column, tolerance: float) -> tuple[Column, Column]:
    """The ends of a ratio's band, floored and ceiled."""
    return F.floor(expected * (1 - tolerance)), F.ceil(expected * (1 + tolerance))


def within(observed: Column, expected: Column, tolerance: float) -> Column:
    """Within a ratio of the expected value: the band's ends are floored and ceiled."""
    return observed.between(*band(expected, tolerance))


def manifest(observed: DataFrame, expected: DataFrame, key: str = "claim") -> DataFrame:
    """(key, ok, observed, expected): observed counts against expected ones with their kind of tolerance."""
    rows = expected.join(observed, key, "left")
    ok = F.when(F.col("kind") == "absolute", F.abs(F.col("observed") - F.col("expected")) <= F.col("tolerance")).otherwise(within(F.col("observed"), F.col("expected"), 0.0) | (F.abs(F.col("observed") - F.col("expected")) <= F.col("tolerance") * F.col("expected")))
    return rows.select(key, F.coalesce(ok, F.lit(False)).alias("ok"), "observed", "expected")


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's values as JSON with sorted names; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def snapshot(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n, digest) of a table's content in any order: counts, and sums of 32-bit parts of the row hashes.

    Sums are combined before the shuffle, so no list of hashes is gathered; a row more, less or changed changes them.
    """
    h = row_hash(df, columns)
    part = lambda k: F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(".", F.lit("s"), *(F.coalesce(part(k), F.lit("0")) for k in range(8))), 256).alias("digest"))


def key_union(df: DataFrame, label: str, json: str) -> DataFrame:
    """(label, keys): sorted distinct keys of JSON objects."""
    return df.select(label, F.explode(F.json_object_keys(json)).alias("k")).groupBy(label).agg(F.sort_array(F.collect_set("k")).alias("keys"))


def vector_groups(df: DataFrame, vector: str, gloss: str) -> DataFrame:
    """(rows, groups, penalised, ratio): equal vectors whose glosses differ count against an index."""
    g = df.groupBy(vector).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(gloss).alias("g"))
    bad = F.sum(F.when(F.col("g") > 1, F.col("n") - 1).otherwise(0))
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), bad.alias("penalised"), F.round(1 - bad / F.sum("n"), 6).alias("ratio"))


def pair_cosines(df: DataFrame, key: str, vector: str, bucket: int = 4096) -> DataFrame:
    """(mean, deviation, pairs) of cosines of disjoint pairs, neighbours in the order of their hashed keys; (1, 0, 0)
    for fewer than two rows. Rows are paired in buckets of about ``bucket`` that share the first digits of the hash; the
    last of an odd number in a bucket has no pair."""
    digits = max(0, math.ceil(math.log(max(df.count(), 1) / bucket, 16)))
    h = F.md5(F.col(key).cast("string"))
    n = df.select(h.alias("h"), F.substring(h, 1, digits).alias("b"), F.col(key).alias("k"), vector).withColumn("i", F.row_number().over(W.partitionBy("b").orderBy("h", "k")) - 1)
    a, b = (n.where(F.col("i") % 2 == i).select("b", F.floor(F.col("i") / 2).alias("p"), F.col(vector).alias(f"v{i}")) for i in (0, 1))
    c = a.join(b, ["b", "p"]).select(cosine(F.col("v0"), F.col("v1")).alias("c"))
    return c.agg(F.round(F.coalesce(F.avg("c"), F.lit(1.0)), 4).alias("mean"), F.round(F.coalesce(F.stddev_pop("c"), F.lit(0.0)), 4).alias("deviation"), F.count("c").alias("pairs"))


def latency(df: DataFrame, by: str, ms: str) -> DataFrame:
    """(by, p50, p99): median, and nearest-rank 99th percentile."""
    return df.groupBy(by).agg(F.expr(f"percentile({ms}, 0.5)").alias("p50"), F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY {ms})").alias("p99"))


def bounds(name: str, value: int, lo: int, hi: int) -> int:
    """Check a caller's number before a plan is built."""
    if not isinstance(value, int) or isinstance(value, bool) or not lo <= value <= hi:
        raise ValueError(f"{name} must be from {lo} to {hi}, got {value!r}")
    return value


def log_ratio(n: int, df: int) -> float:
    return math.log((n + 1) / (df + 1)) + 1


def tallies(rows: DataFrame, batch: str, by: list[str], key: str) -> DataFrame:
    """(by, batch, n, seen, fresh, total): of each batch its rows, distinct keys, keys that no earlier batch has, and keys so far.

    A key's first batch is a grouped minimum; only the counts of batches, a row each, are summed in order.
    """
    seen = rows.groupBy(*by, batch).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("seen"))
    first = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.min(batch).alias(batch))
    fresh = first.groupBy(*by, batch).agg(F.count(F.lit(1)).alias("fresh"))
    out = seen.join(fresh, [*by, batch], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    return out.withColumn("total", F.sum("fresh").over(W.partitionBy(*by).orderBy(batch).rowsBetween(W.unboundedPreceding, 0)))
