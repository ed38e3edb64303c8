"""Text-Fabric features: node values with implicit counters, type ranges and slot lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import ordered


def node_feature(rows: DataFrame, count_blank: bool = True) -> DataFrame:
    """(file, node, value) of lines ``node<TAB>value``, ``lo-hi<TAB>value`` or a bare value for the next node.

    ``rows``: (file, line_no, line) below the header. ``count_blank``: does a blank line stand for a node without a
    value (one corpus's rule) or for nothing (another's)? Explicit nodes are anchors; a bare value's node is the last
    anchor's plus the lines since: two prefix scans over splits of the file, so no task has a whole one.
    """
    rows = rows if count_blank else rows.where(F.trim("line") != "")
    spec = F.regexp_extract("line", "^(\\d+(?:-\\d+)?)\\t", 1)
    lo, hi = F.regexp_extract(spec, "^(\\d+)", 1).try_cast("long"), F.regexp_extract(spec, "(\\d+)$", 1).try_cast("long")
    n = rows.withColumns({"lo": lo, "hi": hi, "value": F.when(spec != "", F.substring_index("line", "\t", -1)).otherwise(F.col("line"))})
    n = ordered.scan(n, ["file"], "line_no", counts={"k": F.lit(True)})
    # a bare value's node is its place and how far the last anchor's node lies from the anchor's place
    n = ordered.scan(n, ["file"], "line_no", last={"ahead": F.col("hi") - F.col("k")})
    own = F.col("k") + F.coalesce("ahead", F.lit(0))
    nodes = F.when(F.col("lo").isNotNull(), F.sequence("lo", F.greatest("lo", "hi"))).otherwise(F.array(own))
    return n.withColumn("node", F.explode(nodes)).where(F.col("lo").isNotNull() | (F.trim("value") != "")).select("file", "node", "value")


def type_ranges(rows: DataFrame) -> DataFrame:
    """(otype, lo, hi) of lines ``lo-hi<TAB>type``."""
    part = lambda k: F.regexp_extract("line", "^(\\d+)-?(\\d*)\\t(.+)$", k)
    return rows.where(F.col("line").rlike("^\\d+(-\\d+)?\\t")).select(
        part(3).alias("otype"), part(1).cast("long").alias("lo"), F.when(part(2) != "", part(2)).otherwise(part(1)).cast("long").alias("hi")
    )


def slots(spec: Column) -> Column:
    """``1-3,7`` as an array of slots; pieces that go down are left out."""
    def piece(p: Column) -> Column:
        lo, hi = F.regexp_extract(p, "^\\s*(\\d+)", 1).try_cast("long"), F.regexp_extract(p, "(\\d+)\\s*$", 1).try_cast("long")
        return F.when(hi >= lo, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.filter(F.split(spec, ","), lambda p: F.trim(p) != ""), piece))


def slot_owners(nodes: DataFrame) -> DataFrame:
    """(slot, node): each slot's owner; of several nodes the last one wins. ``nodes``: (node, slots array)."""
    return nodes.select("node", F.explode("slots").alias("slot")).groupBy("slot").agg(F.max("node").alias("node"))
