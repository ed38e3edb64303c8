"""A stored keyword index, and exact BM25 top-k that skips what can't be among the first.

The index is three tables: ``docs`` (id, segment, dl, tokens, tfs: each of a document's tokens once, with its count), ``terms`` (token, df, peak) and
``blocks`` (token, segment, block, peak, ids, tfs, dls). A token's postings are kept by segments of documents, so that no group grows with the token's frequency, and within a segment in
blocks of ``BLOCK`` by falling impact; ``peak`` is the greatest impact of a block or token, by the index's own k1, b and mean length.

A search has three steps, all joins on tokens or ids: scores of the documents in each token's first blocks give a threshold for each
query, the k-th best full score among them; the query's weakest tokens, which together can't reach ``SHARE`` of it, are not essential
(MaxScore), and of the others only blocks are read whose peak, with the most that the query's other tokens can add, reaches it
(block-max); documents whose sum over these blocks, with the most that weak tokens can add, reaches it are scored in full. A document
with a score of the threshold or more has all blocks of its essential tokens read, so the result is exact.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.operators.retrieval import MOST_TERMS, top

SEGMENT, BLOCK = 65_536, 128
#: Postings that a task groups: its memory doesn't grow with the table.
TASK = 1 << 19
#: Of the threshold, what the tokens that are not read may reach.
SHARE = 0.3
#: Pairs of a query and a document that are broadcast (two longs each); more are joined by a shuffle.
MOST_PAIRS = 1_000_000
#: What rounding in sums may take off a score.
SLACK = 1e-9


@dataclass
class Index:
    docs: DataFrame
    terms: DataFrame
    blocks: DataFrame
    n: int
    mean: float
    k1: float
    b: float
    path: str

    def impact(self, tf: Column, dl: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.mean))

    def weight(self, df: Column) -> Column:
        return F.log(1 + (self.n - df + 0.5) / (df + 0.5))


def counted(docs: DataFrame) -> DataFrame:
    """(id, dl, tokens, tfs) of (id, tokens): each token of a document once, in order, with its count; null tokens are none.

    Equal tokens lie together once sorted, so a row is counted by itself in linear time. Each step's arrays are named before the next
    uses them, so that no lambda computes them again.
    """
    rows = docs.select("id", F.array_sort(F.coalesce("tokens", F.expr("array()"))).alias("said"))
    new = lambda i: (i == 0) | ~F.get("said", i).eqNullSafe(F.get("said", i - 1))
    at = F.when(F.size("said") > 0, F.filter(F.sequence(F.lit(0), F.size("said") - 1), new)).otherwise(F.expr("array()").cast("array<int>"))
    rows = rows.select("id", "said", F.size("said").alias("dl"), at.alias("at"))
    tfs = F.transform("at", lambda i, k: F.coalesce(F.get("at", k + 1), F.col("dl")) - i)
    return rows.select("id", "dl", F.transform("at", lambda i: F.get("said", i)).alias("tokens"), tfs.alias("tfs"))


def build(docs: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, segment: int = SEGMENT, block: int = BLOCK) -> Index:
    """Write the index of ``docs`` (id, tokens) to ``path``, in place of what is there, and open it."""
    spark = docs.sparkSession
    n = docs.count()
    number = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // segment)))).cast("int")
    counted(docs).select("id", number.alias("segment"), "dl", "tokens", "tfs").write.mode("overwrite").parquet(f"{path}/docs")
    stored = spark.read.parquet(f"{path}/docs")
    mean, postings = stored.agg(F.avg("dl"), F.sum(F.size("tokens"))).first()
    mean = mean or 1.0
    spark.createDataFrame([(n, float(mean) or 1.0, k1, b)], "n long, mean double, k1 double, b double").coalesce(1).write.mode("overwrite").json(f"{path}/about")
    index = Index(stored, None, None, n, float(mean) or 1.0, k1, b, path)
    # one shuffle, of a row for each token of a document: adding up (ids that repeat) and grouping keep to the partitions of (token, segment)
    said = stored.select("id", "segment", "dl", F.explode(F.arrays_zip("tokens", "tfs")).alias("t")).select("id", "segment", "dl", F.col("t.tokens").alias("token"), F.col("t.tfs").alias("tf"))
    tf = said.repartition(max(1, -(-(postings or 0) // TASK)), "token", "segment").groupBy("token", "segment", "id", "dl").agg(F.sum("tf").alias("tf"))
    posting = F.struct(index.impact(F.col("tf"), F.col("dl")).alias("impact"), "id", F.col("tf").cast("int").alias("tf"), "dl")
    group = tf.groupBy("token", "segment").agg(F.sort_array(F.collect_list(posting), asc=False).alias("p"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / block).cast("int")), lambda i: F.slice("p", i * block + 1, F.lit(block)))
    rows = group.select("token", "segment", F.posexplode(cut).alias("block", "p"))
    part = lambda name: F.transform("p", lambda x: x[name]).alias(f"{name}s")
    rows.select("token", "segment", "block", F.col("p")[0]["impact"].alias("peak"), part("id"), part("tf"), part("dl")).write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.groupBy("token").agg(F.sum(F.size("ids")).alias("df"), F.max("peak").alias("peak")).write.mode("overwrite").parquet(f"{path}/terms")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    about = spark.read.schema("n long, mean double, k1 double, b double").json(f"{path}/about").first()
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "terms", "blocks")), about["n"], about["mean"], about["k1"], about["b"], path)


def _query_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, token, idf, most): the tokens of each query that the index has, and the most that each can add."""
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token")).join(index.terms, "token")
    return q.select("query_id", "token", index.weight(F.col("df")).alias("idf")).join(index.terms.select("token", "peak"), "token").select("query_id", "token", "idf", (F.col("idf") * F.col("peak")).alias("most"))


def _stored(index: Index, terms: DataFrame) -> DataFrame:
    """A table of the queries' terms that several steps read, written beside the index under a name of its own."""
    path = f"{index.path}/searches/{uuid.uuid4().hex}"
    terms.write.parquet(path)
    return terms.sparkSession.read.schema(terms.schema).parquet(path)


def _scored(index: Index, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, score) in full of pairs of a query and a document. Documents are shuffled only for more than ``MOST_PAIRS`` pairs."""
    pairs, docs = _stored(index, pairs), index.docs.select("id", "dl", "tokens", "tfs")
    few = F.broadcast if pairs.count() <= MOST_PAIRS else lambda df: df
    asked = terms.groupBy("query_id").agg(F.collect_list(F.struct("token", "idf")).alias("asked"))
    if terms.count() <= MOST_TERMS:
        rows = docs.join(few(pairs), "id").join(F.broadcast(asked), "query_id")
    else:
        rows = docs.join(pairs.join(asked, "query_id"), "id")

    def one(t: Column) -> Column:
        tf = F.get("tfs", (F.array_position("tokens", t["token"]) - 1).cast("int"))
        return F.coalesce(t["idf"] * index.impact(tf, F.col("dl")), F.lit(0.0))

    return rows.select("query_id", "id", F.aggregate("asked", F.lit(0.0), lambda s, t: s + one(t)).alias("score"))


def plan(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query terms, blocks with ``read``: whether a search for the first ``k`` has to read them for a query)."""
    terms = _stored(index, _query_terms(index, queries))
    first = index.blocks.where("block = 0").join(terms, "token").select("query_id", "idf", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    some = first.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.sum(F.col("idf") * index.impact(F.col("p.tfs"), F.col("p.dls"))).alias("score"))
    some = top(some, ["query_id"], 2 * k, F.col("score").desc(), F.col("id")).select("query_id", "id")
    best = top(_scored(index, some, terms), ["query_id"], k, F.col("score").desc(), F.col("id"))
    floor = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))  # fewer than k: no threshold
    by = W.partitionBy("query_id")
    terms = terms.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    terms = terms.withColumn("rest", F.sum("most").over(by) - F.col("most"))
    upto = F.sum("most").over(by.orderBy("most", "token").rowsBetween(W.unboundedPreceding, 0))
    terms = terms.withColumn("essential", upto >= SHARE * F.col("floor"))
    terms = terms.withColumn("weak", F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).over(by))
    terms = _stored(index, terms)
    found = index.blocks.join(terms, "token")
    return terms, found.withColumn("read", F.col("essential") & (F.col("idf") * F.col("peak") + F.col("rest") >= F.col("floor")))


def candidates(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query terms, pairs of a query and a document that may be among its first ``k``)."""
    terms, blocks = plan(index, queries, k)
    # blocks are shuffled whole, by query and segment, and opened there
    p = blocks.where("read").select("query_id", "segment", "idf", "floor", "weak", "ids", "tfs", "dls").repartition("query_id", "segment").select("query_id", "segment", "idf", "floor", "weak", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    part = F.sum(F.col("idf") * index.impact(F.col("p.tfs"), F.col("p.dls")))
    some = p.groupBy("query_id", "segment", F.col("p.ids").alias("id")).agg(part.alias("part"), F.max(F.col("floor") - F.col("weak")).alias("least"))
    return terms, some.where("part >= least").select("query_id", "id")


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the first ``k`` by BM25 of each query (query_id, tokens); any number of queries and terms."""
    terms, pairs = candidates(index, queries, k)
    scored = _scored(index, pairs, terms).withColumn("score", F.round("score", 6))
    return top(scored, ["query_id"], k, F.col("score").desc(), F.col("id"))
