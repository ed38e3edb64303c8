"""Text, reference and ordering queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.functions import licence, refs, strongs, text
from quillgraph.operators import audits, ordered
from quillgraph.plans.registry import query, table
from quillgraph.sources import formats, markup, textfabric


def values(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


#: Lexeme codes in many spellings, sound and not, from the parts' keys.
CODES = """CASE p_partkey % 11 WHEN 0 THEN 'H' || p_partkey WHEN 1 THEN '{H' || p_partkey || 'a}' WHEN 2 THEN 'h' || p_partkey WHEN 3 THEN p_partkey || ' a' WHEN 4 THEN '' || p_partkey WHEN 5 THEN '' || p_partkey WHEN 6 THEN 'a/G' || p_partkey WHEN 7 THEN '' WHEN 8 THEN p_name WHEN 9 THEN p_partkey || 'B' ELSE 'G' || p_partkey END"""
CODE_LANGS = "CASE p_partkey % 3 WHEN 0 THEN 'hb' WHEN 1 THEN 'gk' END"


@query("strongs_canonical", f"""WITH v AS (SELECT p_partkey, {CODES} AS raw, {CODE_LANGS} AS lang FROM part), a AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^\\{{(.*)\\}}$', '\\1'), '^[^/]*/(.+)$', '\\1') AS s FROM v),
b AS (SELECT *, CASE WHEN regexp_matches(s, '^[HGhg][0-9]+[A-Za-z]?$') THEN upper(s[1]) WHEN regexp_matches(s, '^[0-9]+( ?[A-Za-z])?$') AND lang = 'hb' THEN 'H' WHEN regexp_matches(s, '^[0-9]+( ?[A-Za-z])?$') AND lang = 'gk' THEN 'G' END AS h, regexp_extract(s, '[0-9]+') AS d, nullif(upper(regexp_extract(s, '[0-9] ?([A-Za-z])$', 1)), '') AS x FROM a)
SELECT p_partkey, raw, lang, h || repeat('0', greatest(0, 4 - length(d))) || d || coalesce(x, '') AS canonical, CASE WHEN h IS NOT NULL THEN x END AS suffix FROM b""")
def strongs_canonical(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", F.expr(CODES).alias("raw"), F.expr(CODE_LANGS).alias("lang"))
    return v.select("p_partkey", "raw", "lang", strongs.canonical(F.col("raw"), F.col("lang")).alias("c")).select("p_partkey", "raw", "lang", "c.canonical", "c.suffix")


#: References with lists and ranges, some of which go down, and tokens that are none.
REFS = """CASE o_orderkey % 7 WHEN 0 THEN 'bad' || o_orderkey WHEN 1 THEN '1John.' || (o_custkey % 5 + 1) || '.' || (o_orderkey % 9 + 1) || ', ' || (o_orderkey % 20 + 1) || '-' || (o_orderkey % 20 + 4)
 WHEN 2 THEN 'John.' || (o_custkey % 21 + 1) || '.' || (o_orderkey % 50 + 1) ELSE 'Ps.' || (o_custkey % 150 + 1) || '.' || (o_orderkey % 12 + 1) || '-' || (o_custkey % 15 + 1) || ',' || (o_orderkey % 30 + 1) END"""


@query("ref_expand", f"""WITH v AS (SELECT o_orderkey, {REFS} AS token FROM orders), p AS (SELECT o_orderkey, token, regexp_extract(token, '^([1-3]?[A-Za-z]+)\\.([0-9]+)\\.(.+)$', 1) AS book, regexp_extract(token, '^([1-3]?[A-Za-z]+)\\.([0-9]+)\\.(.+)$', 2) AS ch, unnest(string_split(regexp_extract(token, '^([1-3]?[A-Za-z]+)\\.([0-9]+)\\.(.+)$', 3), ',')) AS piece FROM v),
r AS (SELECT o_orderkey, token, book, ch, trim(split_part(piece, '-', 1)) AS lo, CASE WHEN contains(piece, '-') THEN trim(split_part(piece, '-', 2)) ELSE trim(piece) END AS hi FROM p WHERE book <> '')
SELECT o_orderkey, token, book, ch::INT AS chapter, unnest(range(lo::INT, hi::INT + 1))::INT AS verse FROM r WHERE hi::INT >= lo::INT""")
def ref_expand(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(REFS).alias("token"))
    return v.select("o_orderkey", "token", F.explode(refs.expand(F.col("token"))).alias("r")).select("o_orderkey", "token", "r.book", "r.chapter", "r.verse")


#: Human references: names of books, one of them unknown, with single verses and ranges.
HUMAN = """CASE o_orderkey % 5 WHEN 0 THEN 'John' WHEN 1 THEN '1 Samuel' WHEN 2 THEN 'Genesis' WHEN 3 THEN 'Nowhere' ELSE 'Psalm' END || ' ' || (o_custkey % 20 + 1) || ':' || (o_orderkey % 17 + 1) || CASE WHEN o_custkey % 2 = 0 THEN '-' || (o_orderkey % 17 + o_custkey % 6 - 1) ELSE '' END"""


@query("human_refs", f"""WITH v AS (SELECT o_orderkey, {HUMAN} AS human, ['John', '1Sam', 'Gen', NULL, 'Ps'][1 + o_orderkey % 5] AS book, o_custkey % 20 + 1 AS ch, o_orderkey % 17 + 1 AS lo, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 17 + o_custkey % 6 - 1 ELSE o_orderkey % 17 + 1 END AS hi FROM orders)
SELECT o_orderkey, human, book || '.' || ch || '.' || unnest(range(lo, hi + 1)) AS key FROM v WHERE book IS NOT NULL AND hi >= lo""")
def human_refs(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(HUMAN).alias("human"))
    return v.select("o_orderkey", "human", F.explode(refs.to_keys(F.col("human"))).alias("key"))


@query("versification_bridge", "WITH rules(n, f, t) AS (VALUES (1, 'Ord.1.1', 'Ord.9.9'), (2, 'Ord.1.1', 'Ord.8.8'), (3, 'Ord.2.3', 'Ord.2.4')), o AS (SELECT o_orderkey, 'Ord.' || (o_orderkey % 5) || '.' || (o_orderkey % 7) AS ref FROM orders) SELECT o_orderkey, ref, coalesce(t, ref) AS mapped FROM o LEFT JOIN (SELECT f, arg_min(t, n) AS t FROM rules GROUP BY f) ON ref = f")
def versification_bridge(spark, sf_dir):
    rules = values(spark, [(1, "Ord.1.1", "Ord.9.9"), (2, "Ord.1.1", "Ord.8.8"), (3, "Ord.2.3", "Ord.2.4")], "n int, from_ref string, to_ref string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(".", F.lit("Ord"), (F.col("o_orderkey") % 5).cast("string"), (F.col("o_orderkey") % 7).cast("string")).alias("ref"))
    return ordered.bridged(o, rules, "ref", ["n"])


#: A licence for each document, from its source's number. Fixed for these queries.
LICENCES = ["public_domain", "CC-BY-NC-4.0", "SBLGNT-EULA", "macula-greek", "© 2020", "unknown", ""]
DOC_LICENCE = "['public_domain', 'CC-BY-NC-4.0', 'SBLGNT-EULA', 'macula-greek', '© 2020', 'unknown', ''][1 + regexp_extract(source, '[0-9]+')::INT % 7]"
DOC_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
#: The guard's outcome in SQL, without the reasons' wording.
GUARD = """CASE WHEN lic = '' THEN false WHEN lower(lic) IN ('public_domain', 'pd', 'cc0', 'cc-by', 'cc-by-4.0', 'cc-by-sa-4.0') THEN true WHEN lic = 'SBLGNT-EULA' THEN mode = 'snippet'
 WHEN lower(lic) IN ('cc-by-nc-4.0', 'macula-greek') OR lic LIKE '©%' THEN mode = 'snippet' AND w > 0 AND w <= 100 AND w <= 0.01 * sw ELSE false END"""


def licensed(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lic = F.element_at(F.array(*map(F.lit, LICENCES)), 1 + F.regexp_extract("source", "[0-9]+", 0).cast("int") % 7)
    return d.select("doc_id", "text", lic.alias("lic"), text.word_count(F.col("text")).alias("w"))


@query("license_guard", f"WITH d AS (SELECT doc_id, {DOC_LICENCE} AS lic, {DOC_WORDS} AS w FROM documents), m AS (SELECT *, unnest(['bulk', 'snippet']) AS mode, 20000 AS sw FROM d) SELECT doc_id, lic, mode, {GUARD} AS allowed FROM m")
def license_guard(spark, sf_dir):
    d = licensed(spark, sf_dir).withColumn("mode", F.explode(F.array(F.lit("bulk"), F.lit("snippet"))))
    return d.select("doc_id", "lic", "mode", licence.guard(F.col("lic"), F.col("mode"), F.col("w"), 20000)["allowed"].alias("allowed"))


@query("envelope_audit", f"WITH d AS (SELECT doc_id, {DOC_LICENCE} AS lic, 10 AS w, 'snippet' AS mode, 20000 AS sw FROM documents), g AS (SELECT doc_id // 10 AS response, {GUARD} AS ok FROM d) SELECT response, bool_and(ok) AS safe, count(*) AS n_sources, count(*) FILTER (WHERE NOT ok) AS n_denied FROM g GROUP BY 1")
def envelope_audit(spark, sf_dir):
    d = licensed(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias("response"), F.struct(F.concat(F.lit("d"), "doc_id").alias("source"), F.col("lic").alias("license")).alias("s"))
    e = d.groupBy("response").agg(F.collect_list("s").alias("sources")).select("response", licence.envelope(F.col("sources"), F.lit("personal"), 10, 20000).alias("e"))
    return e.select("response", F.col("e.response_safe_to_share").alias("safe"), F.size("e.sources_used").alias("n_sources"), F.size(F.filter("e.sources_used", lambda s: ~s["redistribute"])).alias("n_denied"))


@query("snippet_redact", f"WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents) SELECT doc_id, array_to_string(w[:least(100, greatest(1, len(w) // 100))], ' ') AS snippet, CASE WHEN len(w) > 30 THEN array_to_string(w[:30], ' ') || ' ...' ELSE array_to_string(w, ' ') END AS paraphrase FROM d")
def snippet_redact(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(t, text.word_count(t)).alias("snippet"), text.paraphrase(t).alias("paraphrase"))


@query("slugs_and_keywords", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug, array_to_string(list_filter(regexp_extract_all(lower(p_type), '[a-z0-9]+'), lambda t: length(t) > 2), ' ') AS words FROM part")
def slugs_and_keywords(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("slug"), F.array_join(text.keywords(F.col("p_type"), ["the"]), " ").alias("words"))


@query("sentinel_fallback", "SELECT conv_id, turn, CASE WHEN trim(text) IN ('', 'n/a', '?') THEN NULL ELSE trim(text) END AS cleaned, split_part(text, '. ', 1) AS first_sentence FROM conversations")
def sentinel_fallback(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.null_if_blank(F.col("text"), "n/a", "?").alias("cleaned"), text.first_sentence(F.col("text")).alias("first_sentence"))


@query("first_wins_dedupe", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_wins_dedupe(spark, sf_dir):
    return ordered.first_wins(table(spark, sf_dir, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


@query("last_wins_dedupe", "SELECT source, arg_max(doc_id, doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def last_wins_dedupe(spark, sf_dir):
    return ordered.last_wins(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"])


@query("occurrence_ordinal", "WITH d AS (SELECT doc_id, md5(text) AS base, row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id, CASE WHEN k = 0 THEN base ELSE base || '#' || k END AS id FROM d")
def occurrence_ordinal(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("base"))
    return ordered.ordinal_suffix(d, "base", ["doc_id"], "id").select("doc_id", "id")


@query("sub_letters", "WITH e AS (SELECT l_orderkey, l_linenumber, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN k = 1 THEN label ELSE label || chr((96 + k)::INT) END AS sub FROM e")
def sub_letters(spark, sf_dir):
    return ordered.sub_letter(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["l_linenumber"], "sub").select("l_orderkey", "l_linenumber", "sub")


@query("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_purchase FROM events")
def carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return ordered.carry(e, ["user_id"], ["event_id"], "p", "last_purchase").select("event_id", "last_purchase")


@query("strophe_clusters", "SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3 AS strophe, l_linenumber FROM lineitem")
def strophe_clusters(spark, sf_dir):
    return ordered.clusters(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"], 3, "strophe").select("l_orderkey", "strophe", "l_linenumber")


@query("message_sequence", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq FROM conversations")
def message_sequence(spark, sf_dir):
    return ordered.position(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], "seq").select("conv_id", "turn", "role", "seq")


@query("verse_text", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def verse_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()).withColumn("at", F.struct("turn", "text"))
    return ordered.joined_text(c, ["conv_id"], "at", "text")


@query("majority_vote", "SELECT user_id, arg_max(event_type, (n, event_type)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def majority_vote(spark, sf_dir):
    return ordered.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("century_bucket", "SELECT floor(year(o_orderdate) / 100)::INT AS century, list_sort(list(DISTINCT o_orderpriority))::VARCHAR AS refs, count(*) AS n FROM orders GROUP BY 1")
def century_bucket(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.floor(F.year("o_orderdate") / 100).cast("int").alias("century")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ", "), F.lit("]")).alias("refs"), F.count(F.lit(1)).alias("n"))


@query("chunk_pack", """WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''))), lambda n: n > 0) AS c FROM documents),
w AS (SELECT doc_id, c, 1 AS i, 0::BIGINT AS buf, []::BIGINT[] AS done FROM p UNION ALL
 SELECT doc_id, c, i + 1, CASE WHEN buf > 0 AND buf + c[i] > 533 AND buf >= 106 THEN c[i] WHEN buf + c[i] >= 533 THEN 0 ELSE buf + c[i] END, CASE WHEN buf > 0 AND buf + c[i] > 533 AND buf >= 106 THEN list_append(done, buf) WHEN buf + c[i] >= 533 THEN list_append(done, buf + c[i]) ELSE done END FROM w WHERE i <= len(c))
SELECT doc_id, len(CASE WHEN buf > 0 THEN list_append(done, buf) ELSE done END) AS chunks, array_to_string(CASE WHEN buf > 0 THEN list_append(done, buf) ELSE done END, ',') AS words FROM w WHERE i = len(c) + 1""")
def chunk_pack(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.filter(F.transform(F.split("text", "\n"), text.word_count), lambda x: x > 0)
    p = d.select("doc_id", ordered.packed(n).alias("p"))
    return p.select("doc_id", F.size("p").alias("chunks"), F.array_join(F.transform("p", lambda x: x["words"].cast("string")), ",").alias("words"))


@query("marker_sequence", """WITH RECURSIVE m AS (SELECT user_id, list((floor(value)::BIGINT) % 6 ORDER BY event_id) AS c FROM events GROUP BY user_id),
w AS (SELECT user_id, c, 1 AS i, 1::BIGINT AS nxt FROM m UNION ALL SELECT user_id, c, i + 1, CASE WHEN c[i] = nxt THEN nxt + 1 ELSE nxt END FROM w WHERE i <= len(c))
SELECT user_id, nxt - 1 AS accepted FROM w WHERE i = len(c) + 1""")
def marker_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", (F.floor("value") % 6).alias("n")))).alias("m"))
    return e.select("user_id", F.size(ordered.expected_next(F.transform("m", lambda x: x["n"]))).cast("long").alias("accepted"))


#: A feature file's lines, one for each part: explicit nodes, ranges, bare values and blank lines.
FEATURE = "CASE WHEN p_partkey % 9 = 0 THEN (p_partkey * 10) || chr(9) || p_name WHEN p_partkey % 9 = 4 THEN (p_partkey * 10) || '-' || (p_partkey * 10 + p_size % 3) || chr(9) || p_name WHEN p_partkey % 9 = 6 THEN '' ELSE p_brand END"


@query("tf_feature_expand", """WITH f AS (SELECT p_partkey AS k, p_name, p_brand, CASE WHEN p_partkey % 9 IN (0, 4) THEN p_partkey * 10 END AS lo, CASE p_partkey % 9 WHEN 0 THEN p_partkey * 10 WHEN 4 THEN p_partkey * 10 + p_size % 3 END AS hi, row_number() OVER (ORDER BY p_partkey) AS pos FROM part),
a AS (SELECT *, last_value(hi - pos IGNORE NULLS) OVER (ORDER BY pos) AS ahead FROM f)
SELECT unnest(range(lo, hi + 1)) AS node, p_name AS value FROM a WHERE lo IS NOT NULL UNION ALL SELECT pos + coalesce(ahead, 0), p_brand FROM a WHERE lo IS NULL AND k % 9 <> 6""")
def tf_feature_expand(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = p.agg(F.min("p_partkey")).first()[0] or 0  # keys are dense
    rows = p.select(F.lit("f").alias("file"), (F.col("p_partkey") - first + 1).cast("int").alias("line_no"), F.expr(FEATURE).alias("line"))
    return textfabric.node_feature(rows).select("node", "value")


#: Slot lists: a range, a range that may go down, a single slot.
SLOTS = "p_partkey || '-' || (p_partkey + p_size % 4) || ', ' || (p_size + 5) || '-' || (p_size + p_partkey % 10) || ',' || p_size"


@query("tf_slots", f"WITH v AS (SELECT p_partkey, {SLOTS} AS spec, range(p_partkey, p_partkey + p_size % 4 + 1) AS a, CASE WHEN p_partkey % 10 >= 5 THEN range(p_size + 5, p_size + p_partkey % 10 + 1) ELSE [] END AS b, p_size AS c FROM part) SELECT p_partkey, spec, array_to_string(list_append(list_concat(a, b), c), ',') AS slots FROM v")
def tf_slots(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", F.expr(SLOTS).alias("spec"))
    return v.select("p_partkey", "spec", F.array_join(F.transform(textfabric.slots(F.col("spec")), lambda x: x.cast("string")), ",").alias("slots"))


@query("udtf_osis_words", "WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS pos, l_partkey, l_returnflag, l_linestatus FROM lineitem) SELECT l_orderkey, pos::INT AS pos, 'Ord.' || l_orderkey AS verse, l_partkey::VARCHAR AS lemma, CASE WHEN l_returnflag = 'R' THEN 'ketiv' ELSE 'word' END AS kind, l_returnflag || l_linestatus AS surface FROM l UNION ALL SELECT l_orderkey, pos::INT, 'Ord.' || l_orderkey, 'q', 'qere', l_linestatus FROM l WHERE l_returnflag = 'R'")
def udtf_osis_words(spark, sf_dir):
    """Orders as verses of marked-up words, parsed by a table function in SQL; returned lines are written one way and read another."""
    formats.register(spark)
    word = F.concat(F.lit("<w lemma='"), "l_partkey", F.when(F.col("l_returnflag") == "R", "' type='x-ketiv'>").otherwise("'>"), "l_returnflag", "l_linestatus", F.lit("</w>"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("<note><w lemma='q'>"), "l_linestatus", F.lit("</w></note>"))).otherwise(""))
    said = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", word.alias("w")))).alias("l"))
    xml = F.concat(F.lit("<osis><verse osisID='Ord."), "l_orderkey", F.lit("'>"), F.array_join(F.transform("l", lambda x: x["w"]), ""), F.lit("</verse></osis>"))
    view = f"books_{uuid.uuid4().hex}"
    said.select("l_orderkey", xml.alias("xml")).createOrReplaceTempView(view)
    out = spark.sql(f"SELECT b.l_orderkey, w.pos, w.verse, w.lemma, w.kind, w.surface FROM {view} b, LATERAL osis_words(b.xml) w")
    spark.catalog.dropTempView(view)
    return out


@query("udtf_tf_nodes", """WITH f AS (SELECT p_type, p_partkey AS k, p_name, p_brand, CASE WHEN p_partkey % 9 IN (0, 4) THEN p_partkey * 10 END AS lo, CASE p_partkey % 9 WHEN 0 THEN p_partkey * 10 WHEN 4 THEN p_partkey * 10 + p_size % 3 END AS hi, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS pos FROM part),
a AS (SELECT *, last_value(hi - pos IGNORE NULLS) OVER (PARTITION BY p_type ORDER BY pos) AS ahead FROM f)
SELECT p_type AS file, unnest(range(lo, hi + 1)) AS node, p_name AS value FROM a WHERE lo IS NOT NULL UNION ALL SELECT p_type, pos + coalesce(ahead, 0), p_brand FROM a WHERE lo IS NULL AND k % 9 <> 6""")
def udtf_tf_nodes(spark, sf_dir):
    """A feature file for each type of part, parsed by a table function over its lines in order."""
    formats.register(spark)
    view = f"lines_{uuid.uuid4().hex}"
    table(spark, sf_dir, "part").select(F.col("p_type").alias("file"), F.col("p_partkey").alias("line_no"), F.expr(FEATURE).alias("line")).createOrReplaceTempView(view)
    out = spark.sql(f"SELECT file, node, value FROM tf_nodes(TABLE({view}) PARTITION BY file ORDER BY line_no)")
    spark.catalog.dropTempView(view)
    return out


@query("page_links", """SELECT page_id, array_to_string(list_filter(l, lambda h, i: list_position(l, h) = i), ' ') AS links FROM (SELECT page_id, list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1), lambda h: h <> '' AND NOT starts_with(h, '#') AND NOT starts_with(lower(h), 'javascript:')) AS l FROM pages)""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(markup.links(F.col("html")), " ").alias("links"))


@query("html_text")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.html_text("html").alias("text"))


@query("main_content")
def main_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.main_content("html").alias("m")).select("page_id", "m.title", "m.text", F.size("m.paragraphs").alias("paragraphs"))


@query("page_sections")
def page_sections(spark, sf_dir):
    return markup.parsed(table(spark, sf_dir, "pages").select("page_id", "html"), "html", markup.section_rows, markup.SECTION)


@query("hygiene_flags", r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS phones, len(regexp_extract_all(text, '[0-9a-f]{40}')) AS secrets, len(regexp_extract_all(text, 'License')) AS licences FROM documents")
def hygiene_flags(spark, sf_dir):
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), 0))
    return table(spark, sf_dir, "documents").select("doc_id", n("[0-9]{3}-[0-9]{4}").alias("phones"), n("[0-9a-f]{40}").alias("secrets"), n("License").alias("licences"))


@query("line_context", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), f AS (SELECT doc_id, n, contains(line, '###') AS hit, contains(coalesce(lag(line) OVER w, '') || coalesce(lag(line, 2) OVER w, '') || coalesce(lead(line) OVER w, '') || coalesce(lead(line, 2) OVER w, ''), '%%%') AS near FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)) SELECT doc_id, n, CASE WHEN near THEN 'context' ELSE 'plain' END AS category FROM f WHERE hit")
def line_context(spark, sf_dir):
    """Lines with a mark, and whether two lines around have another; windows are arrays of the document's own lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    r = d.select("doc_id", "l", F.posexplode("l").alias("n", "line")).where(F.contains("line", F.lit("###")))
    near = F.concat(*(F.coalesce(F.get("l", F.col("n") + k), F.lit("")) for k in (-1, -2, 1, 2)))
    return r.select("doc_id", "n", F.when(F.contains(near, F.lit("%%%")), "context").otherwise("plain").alias("category"))


#: A stem for every part: most are sound, others have a fault of one family, or of two.
STEMS = """'Whether the ' || p_name || CASE p_partkey % 12 WHEN 0 THEN ' of the Book of Mormon is a tenable reading' WHEN 1 THEN ' is heresy' WHEN 2 THEN ' rests on Sola Fide and imputed righteousness' WHEN 3 THEN ' is a legitimate orthodox position'
 WHEN 4 THEN ' that Ellen G White taught is tenable' WHEN 5 THEN ' corrupts the gospel, as Roman Catholicism says' WHEN 6 THEN ' is forensic justification' WHEN 7 THEN ' whose denial of the ' || p_type || ' is cult-grade' ELSE ' is ' || p_type END"""


def stem_sql() -> str:
    lit = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    every = " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS flag, flatten([{', '.join(f'regexp_extract_all(s, {lit(p)})' for p in ps)}]) AS m FROM v" for n, ps in audits.STEM_FLAGS.items())
    return f"WITH v AS (SELECT p_partkey, {STEMS} AS s FROM part), f AS ({every}) SELECT p_partkey, flag, array_to_string(m, '; ') AS matches FROM f WHERE len(m) > 0"


@query("stem_audit", stem_sql())
def stem_audit(spark, sf_dir):
    """What gives the answer away in each stem, by family."""
    v = table(spark, sf_dir, "part").select("p_partkey", F.explode(audits.stem_flags(F.expr(STEMS))).alias("f"))
    return v.select("p_partkey", "f.flag", F.array_join("f.matches", "; ").alias("matches"))


#: A file of five lines for every order, with old fields in it, spoken of or not.
OLD_LINES = """CASE o_orderkey % 6 WHEN 0 THEN 'x = lexical_score + 1' WHEN 1 THEN 'y = compute_lexical_score(lexical_score)' WHEN 2 THEN '  "confidence": "high",' WHEN 3 THEN '# historical lexical_score' WHEN 4 THEN 'lexical_score  # v30-dead-ref-ok' ELSE 'order ' || o_orderkey END
 || chr(10) || CASE o_orderkey % 4 WHEN 0 THEN 'schema_version follows' WHEN 1 THEN '  "$schema_version": "3.0"' ELSE 'of ' || o_custkey END || chr(10) || 'plain' || chr(10) || CASE o_custkey % 3 WHEN 0 THEN 'v = "3.0"' WHEN 1 THEN 'r.result.confidence > 0' ELSE '' END || chr(10) || CASE o_custkey % 5 WHEN 0 THEN 'from a.evidence_schema import A, Confidence' ELSE 'v3.0 -> v3.1: "3.0"' END"""


@query("line_audit", f"""WITH t AS (SELECT o_orderkey, unnest(string_split({OLD_LINES}, chr(10))) AS line, unnest(range(1, 6)) AS line_no FROM orders),
w AS (SELECT *, coalesce(lag(line, 2) OVER o, '') || chr(10) || coalesce(lag(line) OVER o, '') || chr(10) || line || chr(10) || coalesce(lead(line) OVER o, '') || chr(10) || coalesce(lead(line, 2) OVER o, '') AS near FROM t WINDOW o AS (PARTITION BY o_orderkey ORDER BY line_no)),
k AS (SELECT * FROM w WHERE NOT contains(line, 'v30-dead-ref-ok') AND NOT contains(line, 'v3.0 -> v3.1') AND NOT (line LIKE '#%' AND contains(line, 'historical'))),
c AS (SELECT *, unnest([CASE WHEN contains(line, 'compute_lexical_score') THEN 'compute_lexical_score' WHEN contains(line, 'lexical_score') THEN 'lexical_score' END, CASE WHEN contains(line, '"confidence"') OR contains(line, 'result.confidence') THEN 'verdict_confidence' END, CASE WHEN contains(line, 'Confidence') THEN 'Confidence_import' END,
 CASE WHEN contains(line, '"$schema_version": "3.0"') THEN 'schema_literal_3.0' WHEN contains(line, '"3.0"') AND contains(near, 'schema_version') THEN 'schema_version_3.0' END]) AS category FROM k)
SELECT o_orderkey, line_no::INT AS line_no, category, trim(line) AS snippet FROM c WHERE category IS NOT NULL""")
def line_audit(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(OLD_LINES).alias("text"))
    return audits.line_findings(t).withColumnRenamed("id", "o_orderkey")


@query("normal_forms", "SELECT doc_id, nullif(trim(nfc_normalize(text)), '') AS nfc, nfc_normalize(strip_accents(text)) AS plain FROM documents")
def normal_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.nfc("text").alias("nfc"), text.without_accents("text").alias("plain"))
