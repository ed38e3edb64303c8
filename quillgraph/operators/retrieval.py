"""Ranking: dense and keyword top-k, rank fusion, graph expansion, reranking and balancing. All for many queries at once.

Vectors are searched by blocks (``nearest``), whatever their number. A query table is broadcast only up to ``BROADCAST_QUERIES`` rows,
which is checked.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.operators import nearest

BROADCAST_QUERIES = 1000
#: Terms of all queries of one BM25 search that are broadcast; more are joined.
MOST_TERMS = 200_000


def bounded(queries: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """``queries`` as a broadcast side, after a check of its size."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries at once: search in blocks")
    return F.broadcast(queries)


def in_blocks(queries: DataFrame, key: str, search: Callable[[DataFrame], DataFrame], most: int = BROADCAST_QUERIES) -> DataFrame:
    """``search`` of all queries: of one broadcast table where they are few, else of blocks of them one after another."""
    n = queries.count()
    if n <= most:
        return search(F.broadcast(queries))
    parts = -(-2 * n // most)
    block = F.pmod(F.xxhash64(key), F.lit(parts))
    return reduce(DataFrame.unionByName, [search(bounded(queries.where(block == k), most)) for k in range(parts)])


def top(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank`` from 1. Spark keeps k rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def dense(queries: DataFrame, items: DataFrame, k: int, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(query_id, id, score, rank): exact cosine top-k. queries: (query_id, vector); items: (id, vector, *keep).

    Filters on items belong before this call, so that they reach the scan. Scores are rounded to 6 places, ties go by id.
    """
    return top(nearest.scored(queries, items, k, keep=keep), ["query_id"], k, F.col("score").desc(), F.col("id"))


def dense_by_group(queries: DataFrame, items: DataFrame, group: str, k: int) -> DataFrame:
    """The top ``k`` of each group for each query."""
    found = nearest.scored(queries, items, k, group).select("query_id", group, "id", "score")
    return top(found, ["query_id", group], k, F.col("score").desc(), F.col("id"))


def idf(tokens: DataFrame, n: int | Column) -> DataFrame:
    """(token, df, idf) of (id, token) rows: ln((n + 1) / (df + 1)) + 1."""
    df = tokens.groupBy("token").agg(F.countDistinct("id").alias("df"))
    n = F.lit(n) if isinstance(n, int) else n
    return df.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def keyword_rank(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id, score): summed idf of shared distinct tokens, of the pairs that share one; all others score 0.
    Both: (.., tokens array). The statistics cover all documents, also for tokens that no query has."""
    d = docs.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    mine = d.join(q.select("token").distinct(), "token", "left_semi")
    weight = idf(mine, docs.count())
    hit = mine.join(q.join(weight, "token"), "token")
    return hit.groupBy("query_id", "id").agg(F.round(F.sum("idf"), 4).alias("score"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) by BM25. Statistics cover all documents; only query terms are counted per document."""
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"))
    small = F.broadcast if q.count() <= MOST_TERMS else lambda df: df
    stats = docs.select(F.size("tokens").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    words = docs.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("token")).join(small(q.select("token").distinct()), "token", "left_semi")
    tf = words.groupBy("id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # a row for each query term
    rows = tf.join(small(df), "token").crossJoin(F.broadcast(stats)).join(small(q), "token")
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, ["query_id"], k, F.col("score").desc(), F.col("id"))


def fuse(dense_: DataFrame, sparse: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, score, dense_rank, sparse_rank): reciprocal rank fusion of two ranked lists."""
    d = dense_.select("query_id", "id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "id", F.col("rank").alias("sparse_rank"))
    one = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return d.join(s, ["query_id", "id"], "full_outer").withColumn("score", F.round(one("dense_rank") + one("sparse_rank"), 8))


def cut(fused: DataFrame, k: int) -> DataFrame:
    """The best ``k``; ties go to dense hits first, in rank order."""
    return top(fused, ["query_id"], k, F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank"), F.col("id"))


def hybrid(dense_: DataFrame, sparse: DataFrame, k: int, expand: DataFrame | None = None) -> DataFrame:
    """Both lists of 2k fused and cut to k; with ``expand`` (query_id, id), neighbours that the pools hold follow with
    score 0, up to k // 2 of them."""
    pools = fuse(dense_, sparse)
    best = cut(pools, k).select("query_id", "id", "score", "rank")
    if expand is None:
        return best
    more = expand.join(pools.select("query_id", "id"), ["query_id", "id"], "left_semi").join(best, ["query_id", "id"], "left_anti").distinct()
    more = top(more, ["query_id"], k // 2, F.col("id")).select("query_id", "id", F.lit(0.0).alias("score"), (F.col("rank") + k).cast("int").alias("rank"))
    return best.unionByName(more)


def rerank(hits: DataFrame, texts: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Hits (query_id, id, query, rank) rescored by ``scorer`` (query text, item text): a function of Columns, as a built-in
    expression or a pandas UDF is; without one, in input order."""
    rows = hits.join(texts.select("id", "text"), "id").withColumnRenamed("rank", "input_rank")
    if scorer is None:
        return top(rows, ["query_id"], k, F.col("input_rank"))
    return top(rows.withColumn("rerank_score", scorer(F.col("query"), F.col("text"))), ["query_id"], k, F.col("rerank_score").desc(), F.col("input_rank"))


def balanced(semantic: DataFrame, keyword: DataFrame, types: list[str], each: int = 6, most: int = 56) -> DataFrame:
    """Union with caps: of each type, in the given order, ``each`` semantic hits, then all keyword hits; each id once
    (its first place), ``most`` rows a query. Both: (query_id, type, id, rank)."""
    order = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
    s = semantic.where((F.col("rank") <= each) & (order > 0)).select("query_id", "type", "id", F.lit(0).alias("leg"), order.alias("o"), "rank")
    w = keyword.where(order > 0).select("query_id", "type", "id", F.lit(1).alias("leg"), order.alias("o"), "rank")
    first = s.unionByName(w).withColumn("k", F.row_number().over(W.partitionBy("query_id", "id").orderBy("leg", "o", "rank"))).where("k = 1")
    return top(first.drop("rank", "k").join(s.unionByName(w).select("query_id", "id", "leg", "o", "rank"), ["query_id", "id", "leg", "o"]).withColumnRenamed("rank", "r"), ["query_id"], most, F.col("leg"), F.col("o"), F.col("r"), F.col("id")).select("query_id", "type", "id", "leg", "rank")


#: Intent rules, tried in order. Fixed values: (intent, store, also, expand, pattern).
INTENTS = [
    ("variant_inspect", "lexical", [], False, r"(?i)\b(variant|original reading|manuscript|codex|sinaiticus|vaticanus|byzantine|alexandrian|textus receptus|apparatus|comma johanneum)\b"),
    ("versification", "lexical", [], False, r"(?i)\b(versification|hebrew vs english|english vs hebrew|verse numbering|chapter division|psalm \d+:\d+ hebrew)\b"),
    ("comparative", "lexical", ["cultural"], True, r"(?i)\b(compare|vs\.?|versus|difference between|how does \w+ differ)\b"),
    ("doctrinal_verdict", "lexical", ["cultural"], True, r"(?i)\bdoctrine of\b"),
    ("cultural_overlay", "cultural", [], False, r"(?i)\bwhat does (the )?(\w+) (church |tradition )?teach\b"),
    ("scripture_lookup", "lexical", [], False, r"\b[1-3]?\s?[A-Z][a-z]+\s+\d+:\d+\b|\b[HG]\d{3,5}\b"),
    ("cultural_overlay", "cultural", [], False, r"(?i)\b(reformed|catholic|lutheran|orthodox|anglican|methodist|anabaptist|pentecostal|brethren|wesleyan|baptist|presbyterian)\b"),
]


def route(query: Column, intents=INTENTS) -> Column:
    """struct(intent, store, also, expand, rerank, k) of a question: the first rule whose pattern it has."""
    def decision(intent: str, store: str, also: list[str], expand: bool) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(store).alias("store"), F.array(*map(F.lit, also)).cast("array<string>").alias("also"), F.lit(expand).alias("expand"), F.lit(True).alias("rerank"), F.lit(10).alias("k"))

    general = decision("general", "lexical", ["cultural"], False)
    out = F.when(query.isNull() | (F.trim(query) == ""), general)
    for intent, store, also, expand, pattern in intents:
        out = out.when(query.rlike(pattern), decision(intent, store, also, expand))
    return out.otherwise(general)


#: Limits for a clear and for a near match, by method. Fixed values.
SEMANTIC = {"floor": 0.50, "margin": 0.03, "band": 0.04}
KEYWORD = {"ratio": 1.5, "near": 0.85}


def leading(found: DataFrame, liked: Column) -> DataFrame:
    """(query_id, id, score, rank): of ranked (query_id, id, score) what ``assess`` needs, however many are near: each query's first two, and
    its first two that are ``liked``."""
    two = top(found.withColumn("__liked", liked), ["query_id", "__liked"], 2, F.col("score").desc(), F.col("id")).select("query_id", "id", "score")
    return two.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))


def dense_leading(queries: DataFrame, items: DataFrame, liked: Column) -> DataFrame:
    """``leading`` of exact cosine ranks; ``liked`` is a condition on items."""
    found = nearest.scored(queries, items.withColumn("__kind", liked), 2, "__kind")
    return leading(found.select("query_id", "id", "__kind", "score"), F.col("__kind")).select("query_id", "id", "score", "rank")


def assess(ranked: DataFrame, method: str, prefer: str = "doc-") -> DataFrame:
    """(query_id, matched, confidence) from (query_id, id, score, rank): high for a clear winner, else ambiguous, where
    a near candidate with the ``prefer`` prefix goes first; none if nothing scores. As who is near has the better scores, the first two
    and the first with the prefix tell all (``leading``)."""
    mine = F.when(F.col("id").cast("string").startswith(prefer), F.struct("rank", "id", "score"))
    by = ranked.groupBy("query_id").agg(F.min(F.struct("rank", "id", "score")).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next"), F.min(mine).alias("liked"))
    best, second = F.col("best.score"), F.coalesce("next", F.lit(0.0))
    if method == "semantic":
        high = (best >= SEMANTIC["floor"]) & (F.round(best - second, 6) >= SEMANTIC["margin"])
        near = lambda x: F.coalesce(F.round(best - x, 6) <= SEMANTIC["band"], F.lit(False))
    else:
        high = (second <= 0) | (best / second >= KEYWORD["ratio"])
        near = lambda x: F.coalesce(x >= KEYWORD["near"] * best, F.lit(False))
    matched = F.when(~high & near(F.col("next")) & near(F.col("liked.score")), F.col("liked.id")).otherwise(F.col("best.id"))
    none = best <= 0
    return by.select("query_id", F.when(~none, matched).alias("matched"), F.when(none, "none").when(high, "high").otherwise("ambiguous").alias("confidence"))
