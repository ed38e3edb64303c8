"""Retrieval queries: vectors, keywords, fusion, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import cells, postings, retrieval
from quillgraph.plans.registry import query, shared, table

#: Queries are the vectors whose id is divisible by 50; scores are rounded to 6 places and ties go by id on both sides.
COS = "SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q"


def vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), e


@query("cosine_topk", f"SELECT query_id, id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({COS})) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    q, e = vectors(spark, sf_dir)
    return retrieval.dense(q, e, 10).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query("indexed_topk", f"SELECT query_id, id, label, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({COS}) WHERE label <> 4) WHERE rank <= 10")
def indexed_topk(spark, sf_dir):
    """The same search by a stored index of cells, with a filter on what the index keeps."""
    q, e = vectors(spark, sf_dir)
    index = cells.build(e, shared(spark, "cells"), 32, ["label"])
    return cells.search(index, q, 10, F.col("label") != 4).select("query_id", "id", "label", F.round("score", 4).alias("score"), "rank")


@query("filtered_topk", f"SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({COS}) WHERE label IN (1, 3, 5)) WHERE rank <= 5")
def filtered_topk(spark, sf_dir):
    q, e = vectors(spark, sf_dir)
    return retrieval.dense(q, e.where(F.col("label").isin(1, 3, 5)), 5).select("query_id", "id", "rank")


@query("per_type_topk", f"SELECT query_id, label, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM ({COS})) WHERE rank <= 6")
def per_type_topk(spark, sf_dir):
    q, e = vectors(spark, sf_dir)
    return retrieval.dense_by_group(q, e, "label", 6).select("query_id", "label", "id", "rank")


@query("balanced_union", f"""WITH s AS (SELECT query_id, label, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM ({COS})) WHERE rank <= 6),
k AS (SELECT vec_id // 50 * 50 AS query_id, label, vec_id AS id, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS rank FROM embeddings WHERE vec_id % 50 > 0),
a AS (SELECT *, 0 AS leg FROM s UNION ALL SELECT *, 1 FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY leg, label, rank) AS d FROM a),
o AS (SELECT query_id, label AS type, id, leg, row_number() OVER (PARTITION BY query_id ORDER BY leg, label, rank, id) AS rank FROM f WHERE d = 1) SELECT * FROM o WHERE rank <= 56""")
def balanced_union(spark, sf_dir):
    """The nearest of every type, then the vectors between a query's id and the next query's."""
    q, e = vectors(spark, sf_dir)
    s = retrieval.dense_by_group(q, e, "label", 6).select("query_id", F.col("label").cast("string").alias("type"), "id", "rank")
    k = e.where(F.col("id") % 50 > 0).select((F.floor(F.col("id") / 50) * 50).alias("query_id"), F.col("label").cast("string").alias("type"), "id")
    k = retrieval.top(k, ["query_id"], 49, F.col("id"))
    types = sorted(str(r["label"]) for r in e.select("label").distinct().collect())  # a dimension
    return retrieval.balanced(s, k, types, 6, 56).select("query_id", F.col("type").cast("int").alias("type"), "id", "leg", "rank")


TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({}))"
STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def tokens(c: str) -> str:
    return TOKENS.format(c, STOP)


KEYWORD = f"""d AS (SELECT doc_id AS id, {tokens('text')} AS t FROM documents), q AS (SELECT item_id AS query_id, {tokens('text')} AS t FROM benchmark),
dt AS (SELECT DISTINCT id, unnest(t) AS token FROM d), qt AS (SELECT DISTINCT query_id, unnest(t) AS token FROM q), i AS (SELECT token, ln(((SELECT count(*) FROM d) + 1) / (count(*) + 1)) + 1 AS idf FROM dt GROUP BY token),
h AS (SELECT query_id, id, sum(idf) AS s FROM dt JOIN qt USING (token) JOIN i USING (token) GROUP BY 1, 2)"""


def token_tables(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.keywords(F.col("text")).alias("tokens"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.keywords(F.col("text")).alias("tokens"))
    return q, d


@query("keyword_rank", f"WITH {KEYWORD} SELECT query_id, id, round(s, 4) AS score FROM h")
def keyword_rank(spark, sf_dir):
    q, d = token_tables(spark, sf_dir)
    return retrieval.keyword_rank(q, d)


BM25 = f"""d AS (SELECT doc_id AS id, {tokens('text')} AS t FROM documents), q AS (SELECT item_id AS query_id, {tokens('text')} AS t FROM benchmark), qt AS (SELECT DISTINCT query_id, unnest(t) AS token FROM q),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d), tf AS (SELECT id, len(t) AS dl, token, count(*) AS tf FROM (SELECT id, t, unnest(t) AS token FROM d) GROUP BY id, len(t), token), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN qt USING (token) JOIN df USING (token), st GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def bm25_rows(spark, sf_dir, k):
    q, d = token_tables(spark, sf_dir)
    return retrieval.bm25(q, d, k)


@query("bm25_topk", f"WITH {BM25} SELECT query_id, id, round(score, 3) AS score, rank FROM b WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return bm25_rows(spark, sf_dir, 10).select("query_id", "id", F.round("score", 3).alias("score"), "rank")


@query("bm25_indexed", f"WITH {BM25} SELECT query_id, id, round(score, 3) AS score, rank FROM b WHERE rank <= 3")
def bm25_indexed(spark, sf_dir):
    """The first three from a stored index, whose blocks are skipped where they can't hold one."""
    q, d = token_tables(spark, sf_dir)
    return postings.search(postings.build(d, shared(spark, "postings")), q, 3).select("query_id", "id", F.round("score", 3).alias("score"), "rank")


HYBRID = f"""{BM25}, dn AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({COS})) WHERE rank <= 20), sp AS (SELECT query_id, id, rank FROM b WHERE rank <= 20),
f AS (SELECT query_id, id, dn.rank AS dr, sp.rank AS sr, round(coalesce(1.0::DOUBLE / (60 + dn.rank), 0) + coalesce(1.0::DOUBLE / (60 + sp.rank), 0), 8) AS score FROM dn FULL JOIN sp USING (query_id, id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, sr, id) AS rank FROM f)"""


def hybrid_legs(spark, sf_dir):
    q, e = vectors(spark, sf_dir)
    return retrieval.dense(q, e, 20), bm25_rows(spark, sf_dir, 20)


@query("rrf_hybrid", f"WITH {HYBRID} SELECT query_id, id, score, rank FROM g WHERE rank <= 10")
def rrf_hybrid(spark, sf_dir):
    d, s = hybrid_legs(spark, sf_dir)
    return retrieval.hybrid(d, s, 10)


@query("hybrid_expand", f"WITH {HYBRID}, best AS (SELECT query_id, id, score, rank FROM g WHERE rank <= 10), n AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM f ANTI JOIN best USING (query_id, id) WHERE id % 2 = query_id % 2) SELECT query_id, id, score, rank::INT AS rank FROM best UNION ALL SELECT query_id, id, 0, (k + 10)::INT FROM n WHERE k <= 5")
def hybrid_expand(spark, sf_dir):
    d, s = hybrid_legs(spark, sf_dir)
    every = d.select("query_id", "id").unionByName(s.select("query_id", "id")).where(F.col("id") % 2 == F.col("query_id") % 2)
    return retrieval.hybrid(d, s, 10, every)


@query("rerank_topk", f"WITH {BM25}, r AS (SELECT b.query_id, b.id, b.rank AS input_rank, len(list_intersect(list_distinct(string_split_regex(trim(x.text), '\\s+')), list_distinct(string_split_regex(trim(d.text), '\\s+'))))::DOUBLE AS rerank_score FROM b JOIN benchmark x ON x.item_id = b.query_id JOIN documents d ON d.doc_id = b.id WHERE b.rank <= 20) SELECT * EXCLUDE (input_rank) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, input_rank) AS rank FROM r) WHERE rank <= 5")
def rerank_topk(spark, sf_dir):
    """Reranking with a stand-in scorer: shared distinct words, as a Column. Query texts come by a join of their ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = bm25_rows(spark, sf_dir, 20).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    overlap = lambda a, b: F.size(F.array_intersect(F.split(F.trim(a), "\\s+"), F.split(F.trim(b), "\\s+"))).cast("double")
    return retrieval.rerank(hits, docs, 5, overlap).select("query_id", "id", "rerank_score", "rank")


@query("question_match", f"""WITH r AS (SELECT query_id, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({COS}) WHERE id % 50 > 0), c AS (SELECT query_id, max(CASE WHEN rank = 1 THEN id END) AS best, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2 FROM r GROUP BY 1),
n AS (SELECT r.query_id, count(*) AS near, min(CASE WHEN id % 5 = 0 THEN r.rank END) AS liked FROM r JOIN c ON r.query_id = c.query_id WHERE round(s1 - score, 6) <= 0.04 GROUP BY 1),
h AS (SELECT *, s1 >= 0.5 AND round(s1 - s2, 6) >= 0.03 AS high FROM c JOIN n USING (query_id))
SELECT h.query_id, CASE WHEN s1 <= 0 THEN NULL WHEN high OR near <= 1 OR liked IS NULL THEN CASE WHEN best % 5 = 0 THEN 'doc-' ELSE 'cult-' END || best ELSE 'doc-' || r.id END AS matched, CASE WHEN s1 <= 0 THEN 'none' WHEN high THEN 'high' ELSE 'ambiguous' END AS confidence FROM h LEFT JOIN r ON r.query_id = h.query_id AND r.rank = h.liked""")
def question_match(spark, sf_dir):
    q, e = vectors(spark, sf_dir)
    r = retrieval.dense_leading(q, e.where("id % 50 > 0"), F.col("id") % 5 == 0)
    named = F.concat(F.when(F.col("id") % 5 == 0, "doc-").otherwise("cult-"), F.col("id"))
    return retrieval.assess(r.select("query_id", named.alias("id"), F.round("score", 4).alias("score"), "rank"), "semantic")


#: Questions about every part, in the words of one intent each.
ASKED = """CASE p_partkey % 11 WHEN 0 THEN 'compare the reformed view of ' || p_name WHEN 1 THEN 'What does the Lutheran church teach on ' || p_name || '?' WHEN 2 THEN 'doctrine of ' || p_name WHEN 3 THEN 'John ' || (p_size + 1) || ':16 and ' || p_name
 WHEN 4 THEN 'H0' || (p_partkey % 1000 + 100) || ' ' || p_name WHEN 5 THEN 'codex Sinaiticus reading of ' || p_name WHEN 6 THEN 'psalm 51:' || p_size || ' hebrew' WHEN 7 THEN 'a Baptist view of ' || p_name WHEN 8 THEN p_name || ' ' || p_brand WHEN 9 THEN '' ELSE p_name || ' VS. ' || p_type END"""
ROUTED = "CASE p_partkey % 11 WHEN 0 THEN 'comparative' WHEN 1 THEN 'cultural_overlay' WHEN 2 THEN 'doctrinal_verdict' WHEN 3 THEN 'scripture_lookup' WHEN 4 THEN 'scripture_lookup' WHEN 5 THEN 'variant_inspect' WHEN 6 THEN 'versification' WHEN 7 THEN 'cultural_overlay' WHEN 10 THEN 'comparative' ELSE 'general' END"


@query("intent_route", f"WITH v AS (SELECT p_partkey, {ASKED} AS question, {ROUTED} AS intent FROM part) SELECT p_partkey, question, intent, CASE intent WHEN 'cultural_overlay' THEN 'cultural' ELSE 'lexical' END AS store, intent IN ('comparative', 'doctrinal_verdict') AS expand FROM v")
def intent_route(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", F.expr(ASKED).alias("question"))
    return v.select("p_partkey", "question", retrieval.route(F.col("question")).alias("r")).select("p_partkey", "question", "r.intent", "r.store", "r.expand")
