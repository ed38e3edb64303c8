"""Connected components of a distributed edge list, by alternating large and small stars.

Each round is two grouped passes whose output is written to the shared folder, so lost executors cost one pass. No
edge leaves the executors; the driver only sees two counts a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (large star) or smaller (small star) neighbours to the least of its neighbourhood.

    The least is a plain grouped minimum (summed before the shuffle) that is joined back, so that a node with very
    many neighbours is never gathered into one list.
    """
    if large:
        near = edges.select(F.col("a").alias("n"), F.col("b").alias("o")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("o")))
        least = near.groupBy("n").agg(F.least(F.min("o"), F.first("n")).alias("m"))
        out = near.where(F.col("o") > F.col("n")).join(least, "n").select(F.col("o").alias("a"), F.col("m").alias("b"))
    else:  # edges point from the larger a to the smaller b
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a")
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b of one ordered type): root is the least node reachable."""
    spark = edges.sparkSession
    base = common.run_dir(spark, "components")
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    now = common.stored(ends.distinct(), f"{base}/0")
    for k in range(1, most_rounds + 1):
        # stars only: no node is both an end and a centre
        if now.join(now.select(F.col("b").alias("c")).distinct(), F.col("a") == F.col("c"), "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
        new = common.stored(_star(_star(now, True), False), f"{base}/{k}")
        common.remove(spark, f"{base}/{k - 1}")
        now = new
    else:
        raise RuntimeError(f"components did not converge in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
