"""The tools of the query surface over the driver's tables: orders as verses, parts as lexemes, order lines as words and
tokens, embeddings as chunks of traditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import ordered
from quillgraph.plans import rule_queries, surface
from quillgraph.plans.ranking_queries import COS, vectors
from quillgraph.plans.registry import query, stored, table
from quillgraph.plans.text_queries import DOC_LICENCE, GUARD, LICENCES

#: The lexical store in SQL.
LEX = """vo AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'Gen' WHEN 'O' THEN 'John' ELSE 'Rom' END || '.' || (o_orderkey // 100 + 1) || '.' || (o_orderkey % 100 + 1) AS osis, 'the ' || o_orderpriority || ' of ' || o_custkey AS vtext FROM orders),
lines AS (SELECT l_orderkey || '.' || l_linenumber AS k, printf('H%04d', l_partkey) AS strong, l_linestatus AS lemma, regexp_extract(o_orderpriority, '^\\S+') AS surface, l_linestatus || l_suppkey AS morph, l_returnflag, osis, vtext, o_custkey FROM lineitem JOIN vo ON l_orderkey = o_orderkey),
words AS (SELECT 'w' || k AS id, * FROM lines WHERE l_returnflag <> 'N'), tokens AS (SELECT 't' || k AS id, * FROM lines WHERE l_returnflag = 'N'),
occ AS (SELECT strong, count(*) AS n FROM lines GROUP BY 1), lemmas AS (SELECT printf('H%04d', p_partkey) AS strong, p_name AS lemma, p_brand AS translit, p_type || ' ' || p_size AS english FROM part)"""


def order_lines(spark, sf_dir):
    """Order lines with what their order says."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def lexical(spark, sf_dir, li=None) -> surface.Lexical:
    """The lexical store; ``li``: the order lines, if they are there already."""
    o = table(spark, sf_dir, "orders")
    book = F.when(F.col("o_orderstatus") == "F", "Gen").when(F.col("o_orderstatus") == "O", "John").otherwise("Rom")
    osis = F.concat_ws(".", book, F.floor(F.col("o_orderkey") / 100 + 1).cast("string"), (F.col("o_orderkey") % 100 + 1).cast("string"))
    v = o.select("o_orderkey", "o_custkey", "o_orderpriority", osis.alias("osis"), F.concat(F.lit("the "), "o_orderpriority", F.lit(" of "), "o_custkey").alias("text"), F.when(F.col("o_orderstatus") == "F", "OT").otherwise("NT").alias("canon_section"))
    verses = v.select(F.concat(F.lit("verse:"), "osis").alias("id"), "osis", "text", "canon_section")
    li = (li or order_lines(spark, sf_dir)).withColumn("osis", osis)
    code = lambda c: F.concat(F.lit("H"), ordered.padded(F.col(c), 4))
    k = F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    said = lambda mark: [F.concat(F.lit(mark), k).alias("id"), F.lit("x").alias("source"), code("l_partkey").alias("strong"), F.col("l_linestatus").alias("lemma"), F.regexp_extract("o_orderpriority", "^\\S+", 0).alias("surface"), F.concat("l_linestatus", "l_suppkey").alias("morph"), F.concat(F.lit("verse:"), "osis").alias("verse_id")]
    words, tokens = li.where("l_returnflag <> 'N'").select(*said("w")), li.where("l_returnflag = 'N'").select(*said("t")).drop("lemma")
    p = table(spark, sf_dir, "part")
    lemmas = p.select(F.concat(F.lit("l"), "p_partkey").alias("id"), code("p_partkey").alias("strong"), F.col("p_name").alias("lemma"))
    entries = p.select(code("p_partkey").alias("base_strong"), code("p_partkey").alias("strong_disambig"), F.lit(None).cast("string").alias("greek"), F.col("p_name").alias("hebrew"), F.col("p_brand").alias("transliteration"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("english"))
    edges = v.select(F.concat(F.lit("verse:"), "osis").alias("src_id"), F.concat(F.lit("verse:X."), "o_custkey", F.lit(".1")).alias("dst_id"), F.lit("OPENBIBLE_CROSS_REF").alias("rel_type"), (F.col("o_orderkey") % 30).alias("votes"))
    crossrefs = v.select(F.col("osis").alias("from_ref"), F.concat(F.lit("Y."), F.col("o_custkey") % 50, F.lit(".2")).alias("to_ref"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 20).alias("votes"))
    return surface.Lexical(verses, lemmas, entries, words, tokens, edges, crossrefs)


@query("tool_lexical_lookup", f"""WITH {LEX}, hit AS (SELECT 'strong' AS kind, strong, lemma FROM lemmas WHERE strong = 'H0005' UNION ALL SELECT 'lemma', strong, lemma FROM lemmas WHERE lemma = 'red widget'
 UNION ALL SELECT 'surface', strong, lemma FROM words WHERE surface = '5-LOW' UNION ALL SELECT 'gloss', strong, lemma FROM lemmas WHERE contains(english, 'ECONOMY 1')),
one AS (SELECT kind, strong, min(lemma) AS raw FROM hit GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY strong) AS r FROM one)
SELECT kind, strong, coalesce(l.lemma, raw) AS lemma, translit AS transliteration, english AS gloss, coalesce(n, 0)::BIGINT AS occurrences, count(*) OVER (PARTITION BY kind) >= 20 AS truncated, true AS safe FROM top LEFT JOIN lemmas l USING (strong) LEFT JOIN occ USING (strong) WHERE r <= 20""")
def tool_lexical_lookup(spark, sf_dir):
    """Lookups by code, lemma, surface and gloss."""
    lex, out = lexical(spark, sf_dir), None
    for kind, asked in (("strong", "H0005"), ("lemma", "red widget"), ("surface", "5-LOW"), ("gloss", "ECONOMY 1")):
        r = surface.lexical_lookup(lex, asked, kind)
        r = r.select(F.lit(kind).alias("kind"), "strong", "lemma", "transliteration", "gloss", F.col("occurrences_in_canon").alias("occurrences"), "truncated", F.col("audit.response_safe_to_share").alias("safe"))
        out = r if out is None else out.unionByName(r)
    return out


@query("tool_occurrences", f"WITH {LEX}, c AS (SELECT strong, 0 AS s, count(*) AS n FROM tokens GROUP BY 1 UNION ALL SELECT strong, 1, count(*) FROM words GROUP BY 1) SELECT strong, sum(n)::BIGINT AS fixed, list_sum(list_distinct(list(n)))::BIGINT AS as_written FROM c GROUP BY strong")
def tool_occurrences(spark, sf_dir):
    """Occurrences of each lexeme: both branches added, and as a UNION of equal counts gives them."""
    lex = lexical(spark, sf_dir)
    a, b = (surface.occurrences(lex, x) for x in (True, False))
    return a.withColumnRenamed("occurrences_in_canon", "fixed").join(b.withColumnRenamed("occurrences_in_canon", "as_written"), "strong")


@query("tool_concordance_walk", f"""WITH {LEX}, w AS (SELECT DISTINCT id AS tok, osis AS ref, surface, morph, string_split(vtext, ' ') AS v FROM (SELECT id, osis, surface, morph, strong, vtext FROM tokens UNION ALL SELECT id, osis, surface, morph, strong, vtext FROM words) WHERE strong = 'H0007')
SELECT tok, ref, surface, morph, 'the' AS context_left, array_to_string(v[3:4], ' ') AS context_right FROM w WHERE ref LIKE 'Gen.%' OR ref LIKE 'Rom.%'""")
def tool_concordance_walk(spark, sf_dir):
    return surface.concordance_walk(lexical(spark, sf_dir), "H0007", limit=2000, filter_book=["Gen", "Rom"], window=2)


@query("tool_cross_ref", f"""WITH {LEX}, e AS (SELECT osis AS ref, 'X.' || o_custkey || '.1' AS to_ref, 'openbible' AS source, o_orderkey % 30 AS votes FROM vo UNION SELECT osis, 'Y.' || (o_custkey % 50) || '.2', 'tsk', CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 20 ELSE 1 END FROM vo)
SELECT ref, to_ref, source, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY votes DESC, to_ref, source) AS rank FROM e WHERE votes >= 2) WHERE rank <= 50""")
def tool_cross_ref(spark, sf_dir):
    lex = lexical(spark, sf_dir)
    return surface.cross_ref(lex, lex.verses.select(F.col("osis").alias("ref")), min_votes=2)


@query("tool_variant_inspect", f"WITH {LEX} SELECT osis AS ref, false AS ecm_published, 0 AS units FROM vo")
def tool_variant_inspect(spark, sf_dir):
    return surface.variant_inspect(lexical(spark, sf_dir).verses.select(F.col("osis").alias("ref"))).select("ref", "ecm_published", F.size("variant_units").alias("units"))


@query("tool_parallel_translation", f"WITH {LEX} SELECT osis AS ref, 'original' AS translation, vtext AS text, CASE WHEN o_orderstatus = 'F' THEN 'hb' ELSE 'gk' END AS lang FROM vo UNION ALL SELECT osis, c, '(translation lookup pending for ' || c || ')', NULL FROM vo, (VALUES ('ESV'), ('KJV')) AS t(c)")
def tool_parallel_translation(spark, sf_dir):
    lex = lexical(spark, sf_dir)
    return surface.parallel_translation(lex, lex.verses.select(F.col("osis").alias("ref")), ["ESV", "KJV"])


@query("tool_versification_resolve", """WITH r AS (SELECT 'A.' || (n_nationkey % 7) || '.1' AS f, min_by('B.' || n_nationkey || '.2', n_nationkey) AS t, min_by(n_name, n_nationkey) AS k, min_by(n_regionkey::VARCHAR, n_nationkey) AS b FROM nation GROUP BY 1),
q AS (SELECT o_orderkey, 'A.' || (o_orderkey % 9) || '.1' AS ref FROM orders)
SELECT o_orderkey, ref, coalesce(t, ref) AS to_ref, coalesce(k, 'identity') AS rule_type, coalesce(b, '') AS block_scope, coalesce(t, ref) AS back FROM q LEFT JOIN r ON ref = f""")
def tool_versification_resolve(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line_no"), F.lit("eng").alias("from_scheme"), F.concat(F.lit("A."), F.col("n_nationkey") % 7, F.lit(".1")).alias("from_ref"), F.lit("heb").alias("to_scheme"), F.concat(F.lit("B."), "n_nationkey", F.lit(".2")).alias("to_ref"), F.col("n_name").alias("rule_type"), F.col("n_regionkey").cast("string").alias("block_scope"))
    q = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("A."), F.col("o_orderkey") % 9, F.lit(".1")).alias("ref"), F.lit("eng").alias("from_scheme"), F.lit("heb").alias("to_scheme"))
    got = surface.versification_resolve(q.drop("o_orderkey").distinct(), n).drop("from_scheme", "to_scheme")
    return q.select("o_orderkey", "ref").join(got, "ref").select("o_orderkey", "ref", "to_ref", "rule_type", "block_scope", F.col("inverse.from_ref").alias("back"))


#: Chunks of traditions in SQL: every vector with a tradition, a licence, a work and a tag.
CHUNKS = """c AS (SELECT vec_id, 'c' || vec_id AS chunk_id, ['reformed', 'lutheran', 'orthodox'][1 + vec_id % 3] AS tradition, CASE WHEN vec_id % 2 = 0 THEN 'Work ' || label ELSE 'w' || label END AS source,
 'd' || label AS doctrine, ['affirms', 'denies', 'qualifies', NULL][1 + vec_id % 4] AS stance, 'words of chunk ' || vec_id AS text, CASE WHEN vec_id % 5 = 0 THEN '© 2020' ELSE 'public_domain' END AS license, vec_id % 5 > 0 AS redistribute FROM embeddings)"""


def chunks(spark, sf_dir):
    i, lit = F.col("vec_id"), lambda *xs: F.array(*map(F.lit, xs))
    pick = lambda n, *xs: F.get(lit(*xs), (i % n).cast("int"))
    tag = F.struct(F.concat(F.lit("d"), "label").alias("doctrine"), pick(4, "affirms", "denies", "qualifies", None).alias("stance"), F.lit(0.9).alias("confidence"))
    other = F.struct(F.lit("other").alias("doctrine"), F.lit("describes").alias("stance"), F.lit(0.95).alias("confidence"))
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), "vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), pick(3, "reformed", "lutheran", "orthodox").alias("tradition"), F.concat(F.lit("w"), "label").alias("work_id"),
        F.when(i % 2 == 0, F.concat(F.lit("Work "), "label")).alias("work_title"), F.array(tag, other).alias("doctrine_tags"), F.concat(F.lit("words of chunk "), "vec_id").alias("text"),
        F.when(i % 5 == 0, "© 2020").otherwise("public_domain").alias("license"), (i % 5 > 0).alias("redistribute"), F.lit(20_000).alias("source_work_word_count"),
    )


def asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.concat(F.lit("d"), "label").alias("doctrine"))


HITS = f"""{CHUNKS}, q AS (SELECT vec_id AS query_id, 'd' || label AS wanted FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, 'c' || id AS chunk_id, id, score FROM ({COS})),
h AS (SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, c.chunk_id) AS rank, score, c.*, CASE WHEN wanted = doctrine THEN stance ELSE 'describes' END AS best FROM s JOIN c USING (chunk_id) JOIN q ON q.query_id = s.query_id WHERE tradition IN ({{}})),
k AS (SELECT * FROM h WHERE rank <= {{}})"""


@query("tool_retrieve_chunks", "WITH " + HITS.format("'reformed', 'orthodox'", 8) + " SELECT query_id, rank, round(score, 4) AS score, chunk_id, tradition, source, best AS stance, license, redistribute FROM k")
def tool_retrieve_chunks(spark, sf_dir):
    """Chunks of two traditions for every fiftieth vector; the stance is that on the query's doctrine."""
    r = surface.retrieve_chunks(asked(spark, sf_dir), chunks(spark, sf_dir), 8, ["reformed", "orthodox"])
    return r.select("query_id", "rank", F.round("score", 4).alias("score"), "chunk_id", "tradition", "source", "stance", "license", "redistribute")


OVERLAY = " SELECT query_id, count(*) AS passages, count(DISTINCT tradition) AS traditions, string_agg(CASE WHEN redistribute THEN text ELSE NULL END, '|' ORDER BY rank) AS shown, bool_and(redistribute) AS safe FROM k GROUP BY 1"


def overlaid(o):
    shown = F.array_join(F.transform(F.filter("passages", lambda p: p["license"] == "public_domain"), lambda p: p["snippet"]), "|")
    return o.select("query_id", F.size("passages").cast("long").alias("passages"), F.size(F.map_keys("by_tradition")).cast("long").alias("traditions"), F.nullif(shown, F.lit("")).alias("shown"), F.col("audit.response_safe_to_share").alias("safe"))


@query("tool_cultural_overlay", "WITH " + HITS.format("'reformed', 'lutheran', 'orthodox'", 10) + OVERLAY)
def tool_cultural_overlay(spark, sf_dir):
    """Passages by tradition with their audit for export: safe only if all may be shared in bulk."""
    return overlaid(surface.cultural_overlay(surface.retrieve_chunks(asked(spark, sf_dir), chunks(spark, sf_dir), 10), "export"))


@query("tool_debate_for_verse", "WITH " + HITS.format("'reformed', 'lutheran', 'orthodox'", 12) + OVERLAY)
def tool_debate_for_verse(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("doctrines", F.array("doctrine", F.lit("other"))).drop("doctrine")
    return overlaid(surface.debate_for_verse(q, chunks(spark, sf_dir), "export"))


@query("tool_doctrinal_verdict", """SELECT c_custkey AS query_id, CASE WHEN c_custkey % 11 > 0 THEN 'doc-' || lower(c_mktsegment) END AS matched, CASE WHEN c_custkey % 11 > 0 THEN 'high' ELSE 'none' END AS confidence,
 CASE WHEN c_custkey % 11 = 0 THEN 'no_matching_question' WHEN c_mktsegment = 'BUILDING' THEN 'evidence_missing' END AS error, CASE WHEN c_custkey % 11 > 0 AND c_mktsegment <> 'BUILDING' THEN CASE WHEN length(c_mktsegment) = 9 THEN 'true' ELSE 'disputed' END END AS verdict,
 CASE WHEN c_custkey % 11 > 0 AND c_mktsegment <> 'BUILDING' THEN CASE WHEN length(c_mktsegment) = 9 THEN 'Yes, the text affirms this.' ELSE 'The text can be read both ways.' END END AS answer,
 CASE WHEN c_custkey % 11 > 0 THEN 2 END AS witness_count, CASE WHEN c_custkey % 11 > 0 THEN 'b' END AS first_witness FROM customer""")
def tool_doctrinal_verdict(spark, sf_dir):
    """A verdict for each customer's question; a segment without evidence and a question that matches none say so."""
    c = table(spark, sf_dir, "customer")
    q = c.select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 11 > 0, F.concat(F.lit("a question on "), F.lower("c_mktsegment"))).otherwise("nothing of note").alias("proposition"))
    seg = c.select("c_mktsegment").distinct()
    questions = seg.select(F.concat(F.lit("doc-"), F.lower("c_mktsegment")).alias("question_id"), F.concat(F.lit("About the "), "c_mktsegment").alias("statement"))
    evidence = seg.where("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("doc-"), F.lower("c_mktsegment")).alias("question_id"), F.when(F.length("c_mktsegment") == 9, "true").otherwise("disputed").alias("affirms"), F.lit("broad").alias("breadth"), F.lit("because").alias("summary"), F.array(F.struct(F.lit("s").alias("source"), F.lit("pd").alias("license"))).alias("sources"))
    w = lambda i, x: F.struct(F.lit(i).alias("witness_id"), F.lit(x).alias("confidence"))
    history = questions.select("question_id", F.array(w("a", 0.5), w("b", 0.9)).alias("witnesses"))
    r = surface.doctrinal_verdict(q, questions, evidence, history=history)
    return r.select("query_id", "matched", "confidence", "error", "verdict", "answer", "witness_count", F.get("top_witnesses", F.lit(0)).alias("first_witness"))


INSPECTED = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'invalid_question_id' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'corrupt' END AS error, CASE WHEN doc_id % 7 > 0 AND doc_id % 5 > 1 THEN quality END AS {} FROM labels"


def inspected(spark, sf_dir, field: str):
    x = table(spark, sf_dir, "labels")
    q = x.select("doc_id", F.concat(F.when(F.col("doc_id") % 7 == 0, "../").otherwise("doc-"), "doc_id").alias("question_id"))
    docs = x.where("doc_id % 5 > 0").select(F.concat(F.when(F.col("doc_id") % 7 == 0, "../").otherwise("doc-"), "doc_id").alias("question_id"), F.when(F.col("doc_id") % 5 == 1, "{oops").otherwise(F.to_json(F.struct(F.col("quality").alias(field)))).alias("json"))
    got = surface.inspect(q.select("question_id"), docs, f"{field} int")
    return q.join(got, "question_id").select("doc_id", "error", F.col(f"doc.{field}").alias(field))


@query("tool_evidence_inspect", INSPECTED.format("verdict"))
def tool_evidence_inspect(spark, sf_dir):
    return inspected(spark, sf_dir, "verdict")


@query("tool_historical_inspect", f"WITH d AS ({rule_queries.fault_sql(rule_queries.ATTESTATION_FAULTS)}) SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'invalid_question_id' WHEN doc_id % 5 = 0 THEN 'historical_missing' WHEN violations <> '' THEN 'historical_corrupt' END AS error, doc_id % 7 > 0 AND doc_id % 5 > 0 AND violations = '' AS present FROM d")
def tool_historical_inspect(spark, sf_dir):
    """Attestations for every document, sound and with faults; a seventh of the requests has no valid id, a fifth no attestation."""
    d = rule_queries.faulty(spark, sf_dir, rule_queries.ATTESTATION, rule_queries.ATTESTATION_FAULTS)
    named = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("../"), "doc_id")).otherwise(F.col("question_id"))
    q = d.select("doc_id", named.alias("question_id"))
    got = surface.historical_inspect(q.select("question_id"), d.where("doc_id % 5 > 0").select(named.alias("question_id"), "json"), full=False)
    return q.join(got, "question_id").select("doc_id", "error", F.coalesce("doc.attestation_present", F.lit(False)).alias("present"))


@query("tool_license_audit", f"WITH d AS (SELECT doc_id // 10 AS request_id, {DOC_LICENCE} AS lic, 'bulk' AS mode, 0 AS w, 0 AS sw FROM documents) SELECT request_id, count(*) AS sources, count(*) FILTER (WHERE {GUARD}) AS allowed, bool_and({GUARD}) AS redistributable FROM d GROUP BY 1 UNION ALL SELECT -1, 0, 0, false")
def tool_license_audit(spark, sf_dir):
    """Ten documents a request, and a request without sources."""
    d = table(spark, sf_dir, "documents")
    lic = F.element_at(F.array(*map(F.lit, LICENCES)), 1 + F.regexp_extract("source", "[0-9]+", 0).cast("int") % 7)
    r = d.groupBy(F.floor(F.col("doc_id") / 10).alias("request_id")).agg(F.collect_list(F.struct(F.col("source"), lic.alias("license"))).alias("sources"))
    none = spark.createDataFrame([(-1, [])], r.schema)
    a = surface.license_audit(r.unionByName(none))
    return a.select("request_id", F.size("per_source").cast("long").alias("sources"), F.size(F.filter("per_source", lambda s: s["bulk"]["allowed"])).cast("long").alias("allowed"), "redistributable")


@query("tool_classify", """SELECT p_partkey AS query_id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'doc-' || lower(p_type) END AS matched, CASE WHEN p_size % 4 = 0 THEN 'none' ELSE 'high' END AS confidence FROM part""")
def tool_classify(spark, sf_dir):
    """Every part's type as a question, by keywords; one in four sizes asks for nothing known."""
    p = table(spark, sf_dir, "part")
    questions = p.select("p_type").distinct().select(F.concat(F.lit("doc-"), F.lower("p_type")).alias("question_id"), F.col("p_type").alias("statement"))
    return surface.classify(p.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("is it "), "p_type")).otherwise("zzz").alias("proposition")), questions)


@query("tool_lexical_bundle", f"""WITH {LEX}, anc AS (SELECT 'q' || o_custkey AS question_id, osis AS ref FROM vo), ev AS (SELECT id, strong, osis FROM tokens UNION ALL SELECT id, strong, osis FROM words),
l AS (SELECT question_id, strong, count(DISTINCT id) AS local FROM anc JOIN ev ON ref = osis GROUP BY 1, 2), lr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY local DESC, strong) AS rank FROM l), cn AS (SELECT strong, count(DISTINCT id) AS canon FROM ev GROUP BY 1),
x AS (SELECT question_id, to_ref, max(votes) AS votes FROM anc JOIN (SELECT osis, 'Y.' || (o_custkey % 50) || '.2' AS to_ref, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 20 ELSE 1 END AS votes FROM vo) ON ref = osis GROUP BY 1, 2), xr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY votes DESC, to_ref) AS rank FROM x),
w AS (SELECT question_id, coalesce(id, 'none:' || ref) AS key, row_number() OVER (PARTITION BY question_id ORDER BY ref, id) AS rank, surface FROM anc LEFT JOIN words ON ref = osis),
an AS (SELECT question_id, strong FROM lr WHERE rank <= 40), dm AS (SELECT DISTINCT printf('H%04d', p_partkey) AS strong, p_name AS lemma, p_brand || '/' || p_size AS code FROM part),
nb AS (SELECT DISTINCT a.question_id, d.code, d.strong, d.lemma FROM an a JOIN dm x USING (strong) JOIN dm d ON d.code = x.code ANTI JOIN an ON an.question_id = a.question_id AND an.strong = d.strong),
nr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY code, strong) AS rank FROM nb),
un AS (SELECT DISTINCT 'u' || l_orderkey AS id, osis AS ref FROM lineitem JOIN vo ON l_orderkey = o_orderkey WHERE l_linenumber = 2 AND o_orderstatus <> 'F'), rd AS (SELECT 'u' || l_orderkey AS unit_id, string_agg('r' || l_linenumber || '=' || l_returnflag, '; ' ORDER BY l_linenumber, l_returnflag) AS said FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
vr AS (SELECT question_id, ref, id, row_number() OVER (PARTITION BY question_id ORDER BY ref, id) AS rank FROM anc JOIN un USING (ref)),
ph AS (SELECT DISTINCT osis AS ref, 'c' || (l_linenumber // 3) || '.' || l_orderkey AS clause_id, 'p' || l_linenumber || '.' || l_orderkey AS phrase_id, 'clause ' || (l_linenumber // 3) AS clause, l_linestatus || l_suppkey AS phrase, CASE WHEN l_linenumber % 2 = 0 THEN 'Pred' ELSE '' END AS function FROM lineitem JOIN vo ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
sr AS (SELECT question_id, ref, clause, phrase, function, row_number() OVER (PARTITION BY question_id ORDER BY ref, clause_id, phrase_id, phrase) AS rank FROM anc LEFT JOIN ph USING (ref))
SELECT question_id, 'lemma' AS part, strong AS key, rank, local || '/' || canon AS value FROM lr JOIN cn USING (strong) WHERE rank <= 40 UNION ALL SELECT question_id, 'xref', to_ref, rank, votes::VARCHAR FROM xr WHERE rank <= 20 UNION ALL SELECT question_id, 'word', key, rank, surface FROM w
UNION ALL SELECT question_id, 'neighbor', code || ':' || strong, rank, lemma FROM nr WHERE rank <= {surface.MOST['neighbor']} UNION ALL SELECT question_id, 'variant', ref || ' ' || id, rank, coalesce(said, '') FROM vr LEFT JOIN rd ON unit_id = id WHERE rank <= {surface.MOST['variant']}
UNION ALL SELECT question_id, 'syntax', ref, rank, coalesce(clause, '') || ' | ' || coalesce(phrase, '') || ' | ' || coalesce(function, '') FROM sr WHERE rank <= {surface.MOST['syntax']}
UNION ALL SELECT question_id, 'scope', 'not_in_ecm_scope', 1, CASE WHEN bool_or(split_part(ref, '.', 1) = 'John' AND split_part(ref, '.', 2)::INT = 3 AND split_part(ref, '.', 3)::INT BETWEEN 1 AND 60) THEN 'false' ELSE 'true' END FROM anc GROUP BY 1""")
def tool_lexical_bundle(spark, sf_dir):
    """Bundles of every customer with orders: the anchors are human references of the orders' verses. Parts of a brand and size are a
    domain; second lines of later books are variant units; lines of the first book are phrases."""
    li = stored(order_lines(spark, sf_dir), "order_lines")
    lex = lexical(spark, sf_dir, li)
    o = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.when(F.col("o_orderstatus") == "F", "Genesis").when(F.col("o_orderstatus") == "O", "John").otherwise("Romans"), F.lit(" "), F.floor(F.col("o_orderkey") / 100 + 1), F.lit(":"), F.col("o_orderkey") % 100 + 1).alias("ref"))
    q = o.groupBy(F.concat(F.lit("q"), "o_custkey").alias("question_id")).agg(F.collect_list("ref").alias("scripture_anchors"))  # a customer's own orders
    p = table(spark, sf_dir, "part")
    lex.domains = p.select(F.concat(F.lit("H"), ordered.padded(F.col("p_partkey"), 4)).alias("strong"), F.col("p_name").alias("lemma"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("domain_code"))
    li = li.withColumns({"chapter": F.floor(F.col("o_orderkey") / 100 + 1).cast("int"), "verse": (F.col("o_orderkey") % 100 + 1).cast("int")})
    unit, line = F.concat(F.lit("u"), "l_orderkey"), F.col("l_linenumber")
    lex.units = li.where("l_linenumber = 2 AND o_orderstatus <> 'F'").select(unit.alias("id"), F.when(F.col("o_orderstatus") == "O", "John").otherwise("Rom").alias("book"), "chapter", "verse").distinct()
    lex.readings = li.where("l_linenumber <= 3").select(F.concat(F.lit("r"), line).alias("id"), unit.alias("unit_id"), F.col("l_returnflag").alias("text"))
    third = F.floor(line / 3).cast("string")
    lex.phrases = li.where("o_orderstatus = 'F'").select(F.concat(F.lit("p"), line, F.lit("."), "l_orderkey").alias("id"), F.concat(F.lit("c"), third, F.lit("."), "l_orderkey").alias("clause_id"), F.concat(F.lit("clause "), third).alias("clause"), F.concat("l_linestatus", "l_suppkey").alias("phrase"), F.when(line % 2 == 0, "Pred").alias("function"), F.concat_ws(".", F.lit("verse:Gen"), F.col("chapter").cast("string"), F.col("verse").cast("string")).alias("verse_id"))
    return surface.lexical_bundle(lex, q, apparatus=("John", 3, 1, 60))


@query("tool_historical_bundle", f"""WITH s AS (SELECT query_id, label::VARCHAR AS type, id, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM ({COS}) WHERE label IN (2, 4, 7)),
k AS (SELECT q.vec_id AS query_id, e.label::VARCHAR AS type, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON e.vec_id // 50 = q.vec_id // 50 WHERE q.vec_id % 50 = 0 AND e.label IN (2, 4, 7)),
a AS (SELECT query_id, type, id, 0 AS leg, list_position(['7', '2', '4'], type) AS o, rank FROM s WHERE rank <= 6 UNION ALL SELECT query_id, type, id, 1, list_position(['7', '2', '4'], type), rank FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY leg, o, rank) AS d FROM a) SELECT * FROM (SELECT query_id, type, id, leg, row_number() OVER (PARTITION BY query_id ORDER BY leg, o, rank, id) AS rank FROM f WHERE d = 1) WHERE rank <= 56""")
def tool_historical_bundle(spark, sf_dir):
    """The nearest chunks of three types in an order of their own, then those that name the query's term."""
    q, e = vectors(spark, sf_dir)
    c = e.select(F.col("id").alias("chunk_id"), F.col("label").cast("string").alias("source_type"), F.concat(F.lit("In the time of Herod "), F.floor(F.col("id") / 50), F.lit(".")).alias("text"), "vector")
    terms = q.select("query_id", F.concat(F.lit("herod "), F.floor(F.col("query_id") / 50), F.lit(".")).alias("term"))
    return surface.historical_bundle(q, c, ["7", "2", "4"], terms)


@query("tool_inputs", f"SELECT item_id, list_sort(list_distinct({{}}))[1:3]::VARCHAR AS words FROM benchmark".format("list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2)"))
def tool_inputs(spark, sf_dir):
    """The first keywords of every benchmark item, as tools read them (without stop words of their own)."""
    k = F.slice(F.sort_array(F.array_distinct(text.keywords(F.col("text"), ["~"]))), 1, 3)
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("["), F.array_join(k, ", "), F.lit("]")).alias("words"))
