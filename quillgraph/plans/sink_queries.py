"""Sinks as round trips: what a sink writes to the shared folder is read back, and SQL says what must be there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.operators import checks
from quillgraph.plans.registry import query, shared, table
from quillgraph.sources import markup, sinks


@query("sink_jsonl", "SELECT doc_id, lang, source, length(text) AS chars FROM documents")
def sink_jsonl(spark, sf_dir):
    """All documents as JSON lines in the order of their ids, written twice and read strictly."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    path = f"{shared(spark, 'sink')}/documents"
    for _ in range(2):
        sinks.jsonl(d, path, ["doc_id", "text"])
    return markup.json_lines(spark, path, "doc_id long, lang string, source string, text string").select("doc_id", "lang", "source", F.length("text").alias("chars"))


@query("sink_points", """WITH k AS (SELECT 'v' || (vec_id // 3) AS key, max(vec_id) AS top, arg_max(label, vec_id) AS label FROM embeddings GROUP BY 1), h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(key)) AS h FROM k)
SELECT left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS id, key, top, label, 64 AS dims FROM h""")
def sink_points(spark, sf_dir):
    """Vector points with stable ids, one for each key; of what was there before nothing stays."""
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.floor(F.col("vec_id") / 3)).alias("key"), F.col("embedding").alias("vector"), F.col("vec_id").alias("top"), "label")
    path = f"{shared(spark, 'sink')}/points"
    for rows in (v.withColumn("key", F.concat(F.lit("old "), "key")), v):
        sinks.vector_points(rows, "key", "vector", str(uuid.NAMESPACE_URL), ["top", "label"]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("id", "payload.key", "payload.top", "payload.label", F.size("vector").alias("dims"))


@query("sink_patched", "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_brand) ELSE p_type END AS p_type, p_size FROM part")
def sink_patched(spark, sf_dir):
    """A payload patched where there is a tag; tags of unknown keys add nothing."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    tags = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, F.col("p_partkey")).otherwise(-F.col("p_partkey") - 1).alias("p_partkey"), F.when(F.col("p_size") != 3, F.upper("p_brand")).alias("p_type"))
    path = f"{shared(spark, 'sink')}/patched"
    sinks.patched(p, tags, "p_partkey", "p_type").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("sink_lists", "SELECT 'unsafe' AS list, doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'publishable', doc_id FROM labels WHERE toxic = 0 AND quality = 1")
def sink_lists(spark, sf_dir):
    """Ids that may not be shared, and documents whose flag is true: one without a flag is in neither list."""
    d = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, False).when(F.col("quality") == 1, True).alias("safe"))
    path = shared(spark, "sink")
    sinks.unsafe_ids(d, "doc_id", "safe").write.mode("overwrite").parquet(f"{path}/list=unsafe")
    sinks.publishable(d, "safe").select("doc_id").write.mode("overwrite").parquet(f"{path}/list=publishable")
    return spark.read.option("basePath", path).parquet(path).select("list", "doc_id")


#: A doctrine for each kind of part.
DOCTRINES = {"ECONOMY": "grace", "SMALL": "law", "MEDIUM": "law", "LARGE": "hope", "STANDARD": "faith", "PROMO": "hope"}


@query("sink_seed", f"WITH m(t, d) AS (VALUES {', '.join(f'({t!r}, {d!r})' for t, d in DOCTRINES.items())}), p AS (SELECT 'q' || p_partkey AS q, p_name, d FROM part JOIN m ON p_type = t) SELECT DISTINCT 'Doctrine' AS kind, d AS key, '' AS value FROM p UNION ALL SELECT 'Question', q, p_name FROM p UNION ALL SELECT 'UNDER_QUESTION', q, d FROM p")
def sink_seed(spark, sf_dir):
    """Doctrines, questions and the edges between them, by the kind of each part."""
    q = table(spark, sf_dir, "part").select(F.concat(F.lit("q"), "p_partkey").alias("question_id"), F.col("p_name").alias("statement"), F.col("p_type").alias("category"))
    t, path = sinks.seed(spark, q, DOCTRINES), shared(spark, "sink")
    t["Doctrine"].select(F.col("id").alias("key"), F.lit("").alias("value")).write.parquet(f"{path}/kind=Doctrine")
    t["Question"].select(F.col("id").alias("key"), F.col("statement").alias("value")).write.parquet(f"{path}/kind=Question")
    t["UNDER_QUESTION"].select(F.col("src_id").alias("key"), F.col("dst_id").alias("value")).write.parquet(f"{path}/kind=UNDER_QUESTION")
    return spark.read.option("basePath", path).parquet(path).select("kind", "key", "value")


@query("sink_embed_text", """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_name ELSE '' END AS l, CASE WHEN p_size % 3 > 0 THEN p_brand END AS t, CASE WHEN p_size % 5 > 1 THEN p_type ELSE ' ' END AS g, CASE WHEN p_size % 7 = 1 THEN 'N' END AS pos FROM part),
h AS (SELECT p_partkey, concat_ws(' ', nullif(l, ''), '(' || t || ')', CASE WHEN trim(g) <> '' THEN ': ' || g END) AS head, pos FROM p), x AS (SELECT p_partkey, concat_ws(' | ', nullif(head, ''), 'pos ' || pos) AS text FROM h)
SELECT p_partkey, text, NULL::BIGINT AS skipped FROM x WHERE trim(text) <> '' UNION ALL SELECT NULL, NULL, count(*) FROM x WHERE trim(text) = ''""")
def sink_embed_text(spark, sf_dir):
    """Texts to embed, of the parts that there are; rows without one are counted and skipped."""
    s, none = F.col("p_size"), F.lit(None).cast("string")
    text = sinks.embed_text(F.when(s % 4 > 0, F.col("p_name")).otherwise(""), F.when(s % 3 > 0, F.col("p_brand")), F.when(s % 5 > 1, F.col("p_type")).otherwise(" "), F.when(s % 7 == 1, "N"), none, none)
    rows, skipped = sinks.with_text(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text")
    return rows.select("p_partkey", "text", F.lit(None).cast("long").alias("skipped")).unionByName(skipped.select(F.lit(None).cast("long").alias("p_partkey"), F.lit(None).cast("string").alias("text"), "skipped"))


@query("sink_wipe", "SELECT count(*) AS before, 0::BIGINT AS tables_left FROM part")
def sink_wipe(spark, sf_dir):
    """A database with a table of all parts, and how many tables are left when it is wiped."""
    name = f"wiped_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    table(spark, sf_dir, "part").select("p_partkey").write.option("path", f"{shared(spark, 'sink')}/parts").saveAsTable(f"{name}.parts")
    before = spark.table(f"{name}.parts").count()
    left = sinks.wipe(spark, name)
    spark.sql(f"DROP DATABASE {name}")
    return spark.range(1).select(F.lit(before).cast("long").alias("before"), F.lit(left).cast("long").alias("tables_left"))


@query("batch_tallies", """WITH e AS (SELECT event_id // 500 AS batch, event_type AS kind, user_id AS id FROM events), f AS (SELECT kind, id, min(batch) AS first FROM e GROUP BY 1, 2), s AS (SELECT kind, batch, count(DISTINCT id) AS seen, count(*) AS n FROM e GROUP BY 1, 2), w AS (SELECT kind, first AS batch, count(*) AS fresh FROM f GROUP BY 1, 2)
SELECT kind, batch, n, seen, coalesce(fresh, 0) AS fresh, sum(coalesce(fresh, 0)) OVER (PARTITION BY kind ORDER BY batch)::BIGINT AS total FROM s LEFT JOIN w USING (kind, batch)""")
def batch_tallies(spark, sf_dir):
    """Users of every kind of event in batches: rows, distinct, not seen in an earlier batch, and seen so far."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).alias("batch"), F.col("event_type").alias("kind"), F.col("user_id").alias("id"))
    return checks.tallies(e, "batch", ["kind"], "id")
