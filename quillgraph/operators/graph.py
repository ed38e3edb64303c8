"""Property-graph operators on node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Merge rows by key: new values win where they aren't null, other columns of the old row stay."""
    b, n = base.alias("b"), new.alias("n")
    on = reduce(lambda x, y: x & y, (F.col(f"b.{k}") == F.col(f"n.{k}") for k in key))
    columns = list(dict.fromkeys([*base.columns, *new.columns]))

    def pick(c: str) -> Column:
        have = [F.col(f"{a}.{c}") for a, d in (("n", new), ("b", base)) if c in d.columns]
        return F.coalesce(*have).alias(c)

    return b.join(n, on, "full_outer").select(*map(pick, columns))


def attach(base: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """Set columns of existing rows; keys that ``base`` doesn't have are never inserted."""
    own = [c for c in values.columns if c not in key]
    out = base.join(values.select(*key, *(F.col(c).alias(f"__{c}") for c in own)), key, "left")
    return out.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in own else F.col(c) for c in base.columns], *[F.col(f"__{c}").alias(c) for c in own if c not in base.columns])


def link(edges: DataFrame, sources: DataFrame, targets: DataFrame, identity: list[str] | None = None) -> DataFrame:
    """Edges (src_id, dst_id, ...) whose ends both exist, one for each identity."""
    s, t = sources.select(F.col("id").alias("src_id")).distinct(), targets.select(F.col("id").alias("dst_id")).distinct()
    return edges.join(s, "src_id", "left_semi").join(t, "dst_id", "left_semi").dropDuplicates(["src_id", "dst_id", *(identity or [])])


def merged_edges(edges: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """One edge for each identity; the others' attributes are those of the last row by ``order``."""
    rest = [c for c in edges.columns if c not in identity]
    last = edges.groupBy(*identity).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*identity, *(F.col(f"r.{c}").alias(c) for c in rest))


def quarantine(edges: DataFrame, nodes: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(edges whose ``column`` is a node, the others)."""
    ids = nodes.select(F.col("id").alias(column)).distinct()
    return edges.join(ids, column, "left_semi"), edges.join(ids, column, "left_anti")


def union_labels(*labels: DataFrame) -> DataFrame:
    """Nodes of several labels as one table; columns that a label lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labels)


def first_match(left: DataFrame, right: DataFrame, key: str, pick: list[str], by: str) -> DataFrame:
    """Left rows with at most one right row each, that with the least ``by``: the right side is reduced first."""
    one = right.groupBy(key).agg(F.min_by(F.struct(*pick), F.struct(by, *pick)).alias("__m"))
    return left.join(one, key, "left").select(*left.columns, *(F.col(f"__m.{c}").alias(c) for c in pick))


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int, both_ways: bool = True) -> DataFrame:
    """(id, hop): nodes within ``hops`` of the seeds and not among them. Each hop joins only the newest nodes."""
    ways = edges.select("src_id", "dst_id")
    if both_ways:
        ways = ways.unionByName(ways.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")))
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen.select("id")
    for h in range(1, hops + 1):
        new = front.join(ways, front["id"] == ways["src_id"]).select(F.col("dst_id").alias("id")).distinct()
        new = new.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h))
        seen, front = seen.unionByName(new), new.select("id")
    return seen.where("hop > 0")


def reached(edges: DataFrame, seeds: DataFrame, hops: int, folder: str) -> DataFrame:
    """(id, hop): nodes that directed edges reach from the seeds within ``hops``, and their least number of hops; no seeds.

    Each hop is a table under ``folder``, which must be new and shared: the plan doesn't grow with the hops, a lost executor costs
    one hop, and the walk ends where a hop finds nothing. Only whether it did comes to the driver.
    """
    spark = edges.sparkSession
    ways = edges.select("src_id", "dst_id")
    seeds.select(F.col("id")).distinct().write.parquet(f"{folder}/hop=0")
    kind = seeds.select("id").schema.add("hop", "integer")
    for h in range(1, hops + 1):
        front = spark.read.parquet(f"{folder}/hop={h - 1}")
        seen = spark.read.schema(kind).option("basePath", folder).parquet(folder)
        new = front.join(ways, front["id"] == ways["src_id"]).select(F.col("dst_id").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        new.write.parquet(f"{folder}/hop={h}")
        if spark.read.schema(seeds.select("id").schema).parquet(f"{folder}/hop={h}").isEmpty():
            break
    return spark.read.schema(kind).option("basePath", folder).parquet(folder).where("hop > 0")


def crawl(pages: DataFrame, hrefs: DataFrame, start: DataFrame, depth: int, per_page: int, most: int) -> DataFrame:
    """Breadth-first walk over stored pages: (url, depth). ``hrefs``: (url, target, at); the first ``per_page`` count."""
    w = W.partitionBy("url").orderBy("at", "target")
    near = hrefs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_page).select("url", F.col("target"))
    near = near.join(pages.select(F.col("url").alias("target")).distinct(), "target", "left_semi")
    seen = start.select("url").distinct().withColumn("depth", F.lit(0))
    front = seen.select("url")
    for d in range(1, depth + 1):
        new = front.join(near, "url").select(F.col("target").alias("url")).distinct().join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        seen, front = seen.unionByName(new), new.select("url")
    return seen.orderBy("depth", "url").limit(most)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("src_id").alias("id")).unionByName(edges.select(F.col("dst_id").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def completed(units: DataFrame, all_: DataFrame, attested: DataFrame, fill: Column) -> DataFrame:
    """A row for every (unit, witness): the attested reading, or ``fill``.

    Units carry the whole (small, fixed) witness list as an array, so no cross join is planned.
    """
    names = all_.agg(F.sort_array(F.collect_set("witness")).alias("names"))
    got = attested.groupBy("unit").agg(F.map_from_entries(F.collect_set(F.struct("witness", "reading"))).alias("got"))
    wide = units.select("unit").distinct().withColumn("__one", F.lit(1)).join(F.broadcast(names.withColumn("__one", F.lit(1))), "__one")
    wide = wide.join(got, "unit", "left").select("unit", "got", F.explode("names").alias("witness"))
    return wide.select("unit", "witness", F.coalesce(F.try_element_at("got", F.col("witness")), fill).alias("reading"))
