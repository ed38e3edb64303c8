"""A stored vector index with exact bounds: cosine top-k that leaves out cells and items which can't be among the first.

Unit vectors lie in the cell of their nearest pivot, with their angle to it. Angles obey the triangle inequality: an item of angle a in a
cell whose pivot has angle p to the query is |p - a| or more away from the query. So a search scores the cells next to the query until
they hold ``k`` items; the k-th score is a threshold, and of all cells only those whose nearest possible item reaches it are joined, by
cell, and of their items only those that reach it are scored. The result is exact for any data; how much is left out depends on it:
much where vectors are in clusters, nothing where they lie evenly in many dimensions.

The index is two tables: ``items`` (cell, angle, id, v and what is kept), and ``cells`` (cell, pivot, least and greatest angle, n), which
has at most ``MOST_PIVOTS`` rows and is broadcast. Queries are joined, never broadcast, so there may be any number of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.vectors import dot, unit
from quillgraph.operators import nearest
from quillgraph.operators.retrieval import top

MOST_PIVOTS = 4096
#: What rounding of scores and angles may hide.
SLACK = 2e-6


@dataclass
class Index:
    items: DataFrame
    cells: DataFrame


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))


def build(items: DataFrame, path: str, pivots: int = 64, keep: list[str] = []) -> Index:  # noqa: B006
    """Write the index of ``items`` (id, vector, *keep) to ``path``, in place of what is there, and open it.

    Pivots are the items of the least hashes of their ids, so the same items give the same index; vectors of length zero are in a
    cell as others are, as if at a right angle to everything.
    """
    if not 0 < pivots <= MOST_PIVOTS:
        raise ValueError(f"1 to {MOST_PIVOTS} pivots")
    spark = items.sparkSession
    v = items.select("id", *keep, unit(F.col("vector")).alias("v"))
    chosen = v.orderBy(F.xxhash64("id"), "id").limit(pivots).select(F.row_number().over(W.orderBy(F.xxhash64("id"), "id")).alias("cell"), F.col("v").alias("pivot"))
    chosen.write.mode("overwrite").parquet(f"{path}/pivots")
    held = spark.read.parquet(f"{path}/pivots").agg(F.sort_array(F.collect_list(F.struct("cell", "pivot"))).alias("pivots"))  # bounded by MOST_PIVOTS
    near = F.array_min(F.transform("pivots", lambda p: F.struct(_angle(F.col("v"), p["pivot"]).alias("angle"), p["cell"].alias("cell"))))
    placed = v.crossJoin(F.broadcast(held)).select("id", *keep, "v", near.alias("n")).select("id", *keep, "v", "n.cell", "n.angle")
    placed.repartition("cell").write.mode("overwrite").parquet(f"{path}/items")
    stored = spark.read.parquet(f"{path}/items")
    sizes = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    sizes.join(spark.read.parquet(f"{path}/pivots"), "cell").write.mode("overwrite").parquet(f"{path}/cells")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/cells"))


def _scored(index: Index, pairs: DataFrame, where: Column | None, floor: bool) -> DataFrame:
    """Scores of the items in the cells of ``pairs`` (query_id, q, cell, angle_q, floor) that can reach the floor."""
    items = index.items if where is None else index.items.where(where)
    both = items.join(pairs, "cell")
    if floor:
        both = both.where(F.cos(F.abs(F.col("angle_q") - F.col("angle"))) >= F.col("floor"))
    kept = [c for c in index.items.columns if c not in ("cell", "angle", "v", "id")]
    return both.select("query_id", "id", *kept, F.round(dot(F.col("v"), F.col("q")), 6).alias("score"))


def _seen(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Each query with every cell and the best score that the cell may hold; and the next cells, up to ``k`` items."""
    q = queries.select("query_id", unit(F.col("vector")).alias("q"))
    seen = q.crossJoin(F.broadcast(index.cells)).withColumn("angle_q", _angle(F.col("q"), F.col("pivot")))
    # an item's angle to the query is at least what the cell's range of angles leaves
    gap = F.greatest(F.col("least") - F.col("angle_q"), F.col("angle_q") - F.col("most"), F.lit(0.0))
    seen = seen.select("query_id", "q", "cell", "n", "angle_q", F.cos(gap).alias("bound"))
    upto = F.sum("n").over(W.partitionBy("query_id").orderBy("angle_q", "cell").rowsBetween(W.unboundedPreceding, 0))
    return seen, seen.withColumn("upto", upto).where(F.col("upto") - F.col("n") < k).drop("upto")


def _reached(seen: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The pairs of ``seen`` whose cell may hold one of the first ``k``, by the k-th of some scores."""
    first = top(scores.select("query_id", "id", "score"), ["query_id"], k, F.col("score").desc(), F.col("id"))
    floor = first.where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("floor"))  # too few there: no floor
    return seen.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))).where(F.col("bound") >= F.col("floor"))


def candidates(index: Index, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, id, *kept, score): scored pairs of each query with the items that may be among its first ``k``."""
    seen, home = _seen(index, queries, k)
    return _scored(index, _reached(seen, _scored(index, home, where, False), k), where, True)


def search(index: Index, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, id, *kept, score, rank): exact cosine top-k of queries (query_id, vector) among the items that hold ``where``.

    A cell's items and the queries that reach it are multiplied in blocks; of each block only a query's first ``k`` are shuffled.
    """
    items = (index.items if where is None else index.items.where(where)).drop("angle").withColumnRenamed("v", "vector")
    kept = [c for c in items.columns if c not in ("cell", "vector", "id")]
    blocks = -(-(index.cells.agg(F.max("n")).first()[0] or 1) // nearest.ITEMS)
    pairs = lambda df: df.select("query_id", F.col("q").alias("vector"), "cell")
    seen, home = _seen(index, queries, k)
    first = nearest.scored(pairs(home), items.select("id", "vector", "cell"), k, by=["cell"], n_items=blocks)
    found = nearest.scored(pairs(_reached(seen, first, k)), items, k, keep=kept, by=["cell"], n_items=blocks)
    return top(found, ["query_id"], k, F.col("score").desc(), F.col("id"))
