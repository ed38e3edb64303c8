"""Scoring, comparison, verification and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import text, vectors
from quillgraph.operators import checks, retrieval, verdict
from quillgraph.plans.registry import query, shared, table
from quillgraph.plans.text_queries import DOC_WORDS
from quillgraph.streaming import ingest, turns

#: Counts of a document that stand in for an evidence document's lists.
DOC_COUNTS = f"SELECT doc_id, n_chars % 2 = 0 AS pan, doc_id % 3 > 0 AS robust, {DOC_WORDS} % 12 AS anchors, n_chars % 20 AS xrefs, doc_id % 15 AS conc, doc_id % 4 AS comp, doc_id % 2 AS addr FROM documents"


@query("verdict_band", f"""WITH d AS ({DOC_COUNTS}), s AS (SELECT *, round(0.25 * CASE WHEN pan THEN 1.0::DOUBLE ELSE 0.3 END + 0.20 * least(anchors, 8) / 8 + 0.15 * CASE WHEN comp > 0 THEN least(addr, comp)::DOUBLE / comp ELSE 1 END + 0.15 * least(xrefs, 12) / 12 + 0.15 * CASE WHEN robust THEN 1.0::DOUBLE ELSE 0.5 END + 0.10 * least(conc, 10) / 10, 4) AS score FROM d)
SELECT doc_id, score, CASE WHEN score >= 0.85 AND pan THEN 'canon_wide' WHEN score >= 0.70 THEN 'broad' WHEN score >= 0.50 THEN 'partial' ELSE 'thin' END AS band FROM s""")
def verdict_band(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = lambda k: (F.col("doc_id") % k)
    s = verdict.breadth(F.col("n_chars") % 2 == 0, n(3) > 0, text.word_count(F.col("text")) % 12, F.col("n_chars") % 20, n(15), n(4), F.least(n(2), n(4)))
    return d.select("doc_id", "n_chars", F.round(s, 4).alias("score")).select("doc_id", "score", verdict.band(F.col("score"), F.col("n_chars") % 2 == 0).alias("band"))


@query("triangle_compare", "WITH a AS (SELECT doc_id, quality, toxic, doc_id % 10 / 10.0::DOUBLE AS conf FROM labels WHERE doc_id % 11 > 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, toxic, doc_id % 10 / 10.0::DOUBLE + CASE WHEN doc_id % 5 = 0 THEN 0.06 ELSE 0.01 END AS conf FROM labels WHERE doc_id % 13 > 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.quality = b.quality AND a.toxic = b.toxic AND abs(a.conf - b.conf) <= 0.05 AS passed FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def triangle_compare(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    conf = (F.col("doc_id") % 10) / 10.0
    a = x.where("doc_id % 11 > 0").select("doc_id", "quality", "toxic", conf.alias("conf"))
    b = x.where("doc_id % 13 > 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), "toxic", (conf + F.when(F.col("doc_id") % 5 == 0, 0.06).otherwise(0.01)).alias("conf"))
    return verdict.compare(a, b, "doc_id", ["quality", "toxic"], [], {"conf": 0.05}).select("doc_id", "passed")


@query("stance_rollup", "WITH t AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'affirms' WHEN toxic = 1 THEN 'denies' END AS stance, doc_id % 4 AS tradition FROM labels), g AS (SELECT tradition, coalesce(stance, 'unstated') AS stance, count(*) AS n, list(doc_id ORDER BY doc_id)[1:2] AS e FROM t GROUP BY 1, 2) SELECT tradition, stance, n, array_to_string(e, ',') AS examples FROM g")
def stance_rollup(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "affirms").when(F.col("toxic") == 1, "denies").alias("stance"), (F.col("doc_id") % 4).alias("tradition"))
    out = verdict.stance_counts(t.withColumn("example", F.col("doc_id").cast("string")), ["tradition"], "example", ["doc_id"])
    return out.select("tradition", "stance", "n", F.array_join("examples", ",").alias("examples"))


@query("top_tags", "WITH e AS (SELECT user_id, event_id, value / (SELECT max(value) FROM events) AS c FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_id) AS r FROM e WHERE c >= 0.6) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY r) AS tags FROM k WHERE r <= 5 GROUP BY user_id")
def top_tags(spark, sf_dir):
    """The surest tags of each user: ranked first, so that no list is longer than what is kept."""
    e = table(spark, sf_dir, "events")
    t = e.crossJoin(F.broadcast(e.agg(F.max("value").alias("m")))).select("user_id", "event_id", (F.col("value") / F.col("m")).alias("confidence"))
    best = retrieval.top(t.where("confidence >= 0.6"), ["user_id"], 5, F.col("confidence").desc(), F.col("event_id"))
    tags = best.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "event_id", "confidence"))).alias("t"))
    return tags.select("user_id", F.array_join(F.transform(verdict.top_tags(F.col("t")), lambda x: x["event_id"].cast("string")), ",").alias("tags"))


@query("json_validate", "SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'k' ELSE '' END AS missing, array_to_string(list_filter(json_keys(props), lambda x: x <> 'k'), ',') AS unknown FROM events")
def json_validate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.get_json_object("props", "$.k").isNull(), "k").otherwise("").alias("missing"), F.array_join(schemas.unknown_keys(F.col("props"), ["k"]), ",").alias("unknown"))


@query("rule_violations", f"SELECT doc_id, concat_ws(',', CASE WHEN w NOT BETWEEN 100 AND 500 THEN 'summary_words' END, CASE WHEN regexp_matches(text, '[–—]') THEN 'no_dashes' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'lang' END) AS violations FROM (SELECT doc_id, text, lang, {DOC_WORDS} AS w FROM documents)")
def rule_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rules = [("summary_words", text.word_count(F.col("text")).between(*verdict.EVIDENCE_WORDS)), ("no_dashes", ~F.col("text").rlike("[–—]")), ("lang", F.col("lang").isin("en", "fr", "de"))]
    return schemas.validated(d, rules).select("doc_id", F.array_join("_violations", ",").alias("violations"))


@query("edge_floors", "SELECT 'orders' AS name, count(*) >= 1000 AS ok, count(*)::VARCHAR AS observed FROM orders UNION ALL SELECT 'self_loops', count(*) = 0, count(*)::VARCHAR FROM lineitem WHERE l_partkey = l_suppkey AND l_partkey < 0 UNION ALL SELECT 'names', count(*) = 0, count(*)::VARCHAR FROM part WHERE trim(p_name) = ''")
def edge_floors(spark, sf_dir):
    one = F.count(F.lit(1))
    rows = [
        checks.check("orders", table(spark, sf_dir, "orders").agg(one), F.col("observed") >= 1000, ">= 1000"),
        checks.check("self_loops", table(spark, sf_dir, "lineitem").where("l_partkey = l_suppkey AND l_partkey < 0").agg(one), F.col("observed") == 0, "0"),
        checks.check("names", table(spark, sf_dir, "part").agg(F.count_if(~checks.filled("string", F.col("p_name")))), F.col("observed") == 0, "0"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).drop("expected")


@query("count_tolerance", "SELECT count(*) AS a, count(DISTINCT (l_orderkey, l_linenumber)) AS b, abs(count(*) - count(DISTINCT (l_orderkey, l_linenumber))) <= 0.01 * count(*) AS agree, floor(count(*) * 0.95)::BIGINT AS lo, ceil(count(*) * 1.05)::BIGINT AS hi FROM lineitem")
def count_tolerance(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("a"), F.countDistinct("l_orderkey", "l_linenumber").alias("b"))
    lo, hi = checks.band(F.col("a"), 0.05)
    return c.select("a", "b", checks.within(F.col("b"), F.col("a"), 0.01).alias("agree"), lo.alias("lo"), hi.alias("hi"))


@query("manifest_audit", "SELECT claim, CASE claim WHEN 'nation' THEN observed = 25 ELSE observed BETWEEN 1 AND 1000000000 END AS ok, observed FROM (SELECT 'nation' AS claim, count(*) AS observed FROM nation UNION ALL SELECT 'orders', count(*) FROM orders)")
def manifest_audit(spark, sf_dir):
    got = table(spark, sf_dir, "nation").agg(F.lit("nation").alias("claim"), F.count(F.lit(1)).alias("observed")).unionByName(table(spark, sf_dir, "orders").agg(F.lit("orders").alias("claim"), F.count(F.lit(1)).alias("observed")))
    want = spark.createDataFrame([("nation", 25, "absolute", 0.0), ("orders", 500_000_000, "absolute", 499_999_999.0)], "claim string, expected long, kind string, tolerance double")
    return checks.manifest(got, want).select("claim", "ok", "observed")


@query("key_union", "SELECT event_type, list_sort(list(DISTINCT k))::VARCHAR AS keys FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def key_union(spark, sf_dir):
    k = checks.key_union(table(spark, sf_dir, "events"), "event_type", "props")
    return k.select("event_type", F.concat(F.lit("["), F.array_join("keys", ", "), F.lit("]")).alias("keys"))


@query("snapshot_hash")
def snapshot_hash(spark, sf_dir):
    out = None
    for name in ("region", "nation", "customer", "labels"):
        s = checks.snapshot(table(spark, sf_dir, name)).withColumn("label", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out.select("label", "n", "digest")


@query("vector_quality", "WITH g AS (SELECT embedding, count(*) AS n, count(DISTINCT label) AS g FROM embeddings GROUP BY 1) SELECT sum(n)::BIGINT AS rows, count(*) AS groups, sum(CASE WHEN g > 1 THEN n - 1 ELSE 0 END)::BIGINT AS penalised, round(1 - sum(CASE WHEN g > 1 THEN n - 1 ELSE 0 END) / sum(n), 6) AS ratio FROM g")
def vector_quality(spark, sf_dir):
    return checks.vector_groups(table(spark, sf_dir, "embeddings"), "embedding", "label")


@query("pair_cosines", """WITH h AS (SELECT md5(vec_id::VARCHAR) AS h, vec_id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT *, left(h, greatest(0, ceil(ln((SELECT count(*) FROM h) / 4096.0) / ln(16)))::INT) AS b FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY h, vec_id) - 1 AS k FROM b), p AS (SELECT list_cosine_similarity(x.v, y.v) AS c FROM n x JOIN n y ON x.b = y.b AND x.k + 1 = y.k WHERE x.k % 2 = 0)
SELECT round(avg(c), 4) AS mean, round(stddev_pop(c), 4) AS deviation, count(*) AS pairs FROM p""")
def pair_cosines(spark, sf_dir):
    return checks.pair_cosines(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("stable_ids", """WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name)) AS h FROM part)
SELECT p_partkey, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS id FROM h""")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", vectors.uuid5(str(uuid.NAMESPACE_URL), F.col("p_name")).alias("id"))


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return checks.latency(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("p50", 6).alias("p50"), "p99")


@query("strong_report", "WITH c AS (SELECT l_partkey AS code, 'a' AS kind FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, 'r' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT p_partkey, 'p' FROM part WHERE p_size = 1) SELECT code, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, any_value(p_name) AS gloss FROM c LEFT JOIN part ON code = p_partkey GROUP BY code")
def strong_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    c = li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("code"), F.lit("a").alias("kind"))
    c = c.unionByName(li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("code"), F.lit("r").alias("kind"))).unionByName(p.where("p_size = 1").select(F.col("p_partkey").alias("code"), F.lit("p").alias("kind")))
    g = c.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return g.join(p.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("gloss")), "code", "left")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling windows in batch; the same plan runs as a stream."""
    return ingest.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "10 minutes").select("start", "event_type", "n")


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    """Runs of a user's events without a pause of half an hour."""
    return ingest.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "30 minutes", "10 minutes").select("user_id", "start", "n")


@query("latest_by_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_by_key(spark, sf_dir):
    """The last event of each user, kept up by micro-batches that rewrite only the key partitions they touch."""
    base = shared(spark, "latest")
    schema = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id").schema
    ingest.merge_latest(spark, f"{sf_dir}/events.parquet*", schema, f"{base}/out", f"{base}/progress", ["user_id"], "event_id", 8)
    return ingest.merged(spark, schema, f"{base}/out").select("user_id", "event_type", "event_id")


@query("turn_stream", "WITH t AS (SELECT conv_id, turn, min(role) AS role FROM conversations WHERE turn IS NOT NULL GROUP BY ALL) SELECT conv_id, turn::INT AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS n, role FROM t")
def turn_stream(spark, sf_dir):
    """Numbers of all conversations' messages by a stream with keyed state, run twice."""
    base = shared(spark, "turns")
    schema = table(spark, sf_dir, "conversations").schema
    for _ in range(2):
        turns.number_files(spark, ingest.pattern(f"{sf_dir}/conversations.parquet"), schema, f"{base}/out", f"{base}/progress")
    return turns.latest(spark, f"{base}/out")


@query("stream_ingest", "SELECT event_id, user_id, event_type FROM events")
def stream_ingest(spark, sf_dir):
    """A resumable file stream run twice: the second run finds nothing new."""
    base = shared(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    pick = lambda s: s.select("event_id", "user_id", "event_type")
    for _ in range(2):
        ingest.ingest(spark, f"{sf_dir}/events.parquet*", schema, f"{base}/out", f"{base}/progress", pick)
    return spark.read.parquet(f"{base}/out")
