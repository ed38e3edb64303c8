"""Document rules, invariants and derived flags as queries.

Documents are made of a sound one and of copies with one fault each; every document of the driver's table gets one of
them, so what a rule finds must be the fault that was put there.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from quillgraph.operators import documents, invariants
from quillgraph.plans.registry import query, table

_WORDS = " ".join(f"word{k}" for k in range(120))
_STRONG = {"strong": "H0430", "lemma": "x"}
EVIDENCE = {
    "$schema_version": "3.1", "id": "doc-@", "question_id": "doc-@", "generated_at": "2025-01-02T03:04:05Z", "pipeline_version": "2", "model": "m",
    "verdict": {"affirms": True, "lexical_breadth": "broad", "lexical_directness": "direct", "variant_stability": None, "variant_robust": True, "pan_canonical": False, "rationale": "r"},
    "lexical_evidence": {
        "anchor_lemmas": [_STRONG | {"transliteration": "t", "occurrences_in_canon": 0, "in_anchors": True}], "concordance_traversed": ["G3056"],
        "scripture": [{"ref": "Gen 1:1", "key_terms": [_STRONG], "reasoning": "r", "supports": "for", "genre": "law", "figures": ["idiom"]}],
        "cross_refs_invoked": [{"from": "a", "to": "b", "source": "tsk", "votes": 0}], "complicating_texts": [{"ref": "a", "addressed": False, "resolution": "r"}],
    },
    "variants": {"verdict_variant_sensitive": False, "variant_units_examined": [{"ref": "a", "variant_id": "v", "verdict_impact": "none", "note": "n"}], "ecm_status": "n/a"},
    "hermeneutics": {"primary_method": "quadriga", "analogia_scripturae": True, "progressive_revelation": False, "competing_lens_verdicts": [{"framework": "f", "verdict": "v", "rationale": "r"}]},
    "stem_audit": {"verdict_preloaded": False, "neutralized_form": None, "notes": ""}, "lay_summary": _WORDS,
    "citations": [{"type": "lexicon", "source": "TSK", "license": "pd", "redistribute": True, "ref": "r"}],
    "license_audit": {"sources_used": [{"source": "s", "license": "pd", "redistribute": True}], "evidence_safe_to_publish": True}, "flags": ["ecm-shadow"],
}
_UNSAFE = {"sources_used": [{"source": "s", "license": "CC-BY-NC-4.0", "redistribute": False}], "evidence_safe_to_publish": False}
#: (rules broken, path in the document, value there).
EVIDENCE_FAULTS = [
    ("", (), None), ("json", None, "{oops"), ("json", None, "[1]"), ("schema_version", ("$schema_version",), "3.0"), ("unknown_keys", ("extra",), 1), ("question_id,id_is_question_id", ("question_id",), ""),
    ("id_is_question_id", ("id",), "other"), ("generated_at", ("generated_at",), "yesterday"), ("made_by", ("model",), ""), ("affirms", ("verdict", "affirms"), "maybe"), ("directness,silent_means_null", ("verdict", "lexical_directness"), None),
    ("breadth", ("verdict", "lexical_breadth"), "wide"), ("stability", ("verdict", "variant_stability"), "x"), ("verdict_flags", ("verdict", "pan_canonical"), None), ("rationale", ("verdict", "rationale"), ""),
    ("silent_means_null", ("verdict", "lexical_directness"), "silent"), ("anchor_lemmas", ("lexical_evidence", "anchor_lemmas", 0, "occurrences_in_canon"), -1), ("concordance", ("lexical_evidence", "concordance_traversed", 0), "3056"),
    ("scripture", ("lexical_evidence", "scripture", 0, "key_terms"), []), ("scripture_kind", ("lexical_evidence", "scripture", 0, "figures", 0), "pun"), ("cross_refs", ("lexical_evidence", "cross_refs_invoked", 0, "source"), "web"),
    ("complicating", ("lexical_evidence", "complicating_texts", 0, "resolution"), ""), ("variants", ("variants", "ecm_status"), "?"), ("variant_units", ("variants", "variant_units_examined", 0, "verdict_impact"), "huge"),
    ("method", ("hermeneutics", "primary_method"), "guess"), ("hermeneutics", ("hermeneutics", "analogia_scripturae"), None), ("lenses", ("hermeneutics", "competing_lens_verdicts", 0, "verdict"), ""),
    ("stem_audit", ("stem_audit", "verdict_preloaded"), None), ("no_dashes", ("lay_summary",), _WORDS + " – x"), ("summary_words", ("lay_summary",), "too short"), ("framing", ("lay_summary",), _WORDS + " and the Lutheran church teaches it"),
    ("citation_kind", ("citations", 0, "type"), "blog"), ("citation_source", ("citations", 0, "source"), "Westminster"), ("source_licences", ("license_audit", "sources_used", 0, "redistribute"), False),
    ("safe_flag", ("license_audit", "evidence_safe_to_publish"), False), ("unsafe_reason", ("license_audit",), _UNSAFE), ("", ("license_audit",), _UNSAFE | {"non_redistributable_reason": "nc"}), ("flags", ("flags", 0), "odd"),
    ("", ("verdict", "affirms"), "disputed"), ("", ("citations",), []),
]
ATTESTATION = {
    "$schema_version": "1.0", "id": "doc-@", "question_id": "doc-@", "generated_at": "t", "pipeline_version": "4", "model": "m", "attestation_present": True,
    "witnesses": [{
        "witness_id": "josephus.ant.18.63", "source_type": "jewish-historian", "attestation_type": "parallel", "confidence": 0.5, "evidence_phrase": "a phrase", "rationale": "r", "text": "t", "text_to_embed": "t", "license": "CC-BY-SA-4.0", "redistribute": True,
        "source": {"source_slug": "josephus", "work_id": "josephus.ant", "work_title": "w", "date_written_range": "d", "anchor_id": "josephus.ant.18.63", "language": "en", "edition": "e"},
        "contested_interpolation": {"type": "none", "note": None, "redact_for_embedding": False}, "provenance": {"original_language": "el", "witness_chain": ["g"], "extant_witnesses": [], "loss_status": "complete"},
    }],
    "summary": _WORDS, "license_audit": {"sources_used": [{"source_slug": "josephus", "license": "PD", "redistribute": True}], "evidence_safe_to_publish": True}, "flags": [],
}
_W = ("witnesses", 0)
ATTESTATION_FAULTS = [
    ("", (), None), ("json", None, "nothing"), ("schema_version", ("$schema_version",), "2"), ("unknown_keys", ("more",), {}), ("id_is_question_id", ("id",), "x"), ("made_by", ("generated_at",), ""), ("presence", ("attestation_present",), False),
    ("presence", ("witnesses",), []), ("slug,anchor", (*_W, "source", "source_slug"), "nobody"), ("anchor,witness_id", (*_W, "source", "anchor_id"), "josephus.ant.18"), ("witness_id", (*_W, "witness_id"), "other"), ("source", (*_W, "source", "edition"), ""),
    ("attestation_type", (*_W, "attestation_type"), "proves"), ("confidence", (*_W, "confidence"), 1.5), ("phrase", (*_W, "evidence_phrase"), _WORDS), ("contested_note", (*_W, "contested_interpolation", "type"), "recension-layer"),
    ("contested_note", (*_W, "contested_interpolation", "note"), "n"), ("redaction", (*_W, "contested_interpolation", "redact_for_embedding"), True), ("provenance", (*_W, "provenance", "witness_chain"), []), ("texts", (*_W, "text"), ""),
    ("licence", (*_W, "license"), "CC-BY-NC-4.0"), ("licence", (*_W, "license"), "unknown"), ("summary_words", ("summary",), "short"), ("no_dashes", (*_W, "rationale"), "a — b"), ("unique_ids", ("witnesses",), "twice"), ("safe_flag", ("license_audit", "evidence_safe_to_publish"), None),
    ("", (*_W, "source_type"), "qumran"),
]


def variant(base: dict, path: tuple | None, value) -> str:
    """The document with one value changed; as text that is no document where there is no path."""
    if path is None:
        return value
    d = copy.deepcopy(base)
    if value == "twice":
        d["witnesses"] = d["witnesses"] * 2
    elif value == "qumran":  # a sound witness of the other kind
        d["witnesses"][0] |= {"source_type": "qumran-sectarian", "witness_id": "1qs.col04.line03"}
        d["witnesses"][0]["source"] |= {"source_slug": "4Q427", "anchor_id": "1qs.col04.line03"}
    elif path:
        at = d
        for step in path[:-1]:
            at = at[step]
        at[path[-1]] = value
    return json.dumps(d, ensure_ascii=False)


def faulty(spark, sf_dir, base: dict, faults: list):
    """doc_id, question_id and ``json``: each document of the table with one of the variants."""
    every = F.array(*(F.lit(variant(base, path, value)) for _, path, value in faults))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("question_id"), F.get(every, (F.col("doc_id") % len(faults)).cast("int")).alias("j"))
    return d.select("doc_id", "question_id", F.replace("j", F.lit("@"), F.col("doc_id").cast("string")).alias("json"))


def fault_sql(faults: list) -> str:
    return f"SELECT doc_id, [{', '.join(repr(name) for name, _, _ in faults)}][1 + doc_id % {len(faults)}] AS violations FROM documents"


@query("evidence_rules", fault_sql(EVIDENCE_FAULTS))
def evidence_rules(spark, sf_dir):
    d = documents.checked(faulty(spark, sf_dir, EVIDENCE, EVIDENCE_FAULTS), "doc_id", "json", "evidence")
    return d.select("doc_id", F.array_join("_violations", ",").alias("violations"))


@query("attestation_rules", fault_sql(ATTESTATION_FAULTS))
def attestation_rules(spark, sf_dir):
    d = documents.checked(faulty(spark, sf_dir, ATTESTATION, ATTESTATION_FAULTS), "doc_id", "json", "attestation")
    return d.select("doc_id", F.array_join("_violations", ",").alias("violations"))


_AUDITS = [
    ([("josephus", "PD", True)], True, None), ([("josephus", "PD", True)], False, "claimed"), ([("philo", "CC-BY-NC-4.0", False), ("josephus", "© 1", False)], True, None), ([("philo", "CC-BY-NC-4.0", False)], False, "kept"),
    ([], False, "none used"), ([("philo", "CC-BY-NC-4.0", True)], True, None), ([("philo", "CC-BY-NC-4.0", False)], True, "said before"),
]
_RESAFE = [(True, None), (True, None), (False, "Cites a non-redistributable source: josephus, philo."), (False, "kept"), (True, None), (False, "Cites a non-redistributable source."), (False, "said before")]


@query("safe_flag", f"SELECT doc_id, [{', '.join(str(a).lower() for a, _ in _RESAFE)}][1 + doc_id % 7] AS safe, [{', '.join('NULL' if b is None else repr(b) for _, b in _RESAFE)}][1 + doc_id % 7] AS reason FROM documents")
def safe_flag(spark, sf_dir):
    """The safe flag derived anew from the sources, whatever a document claims."""
    faults = [("", ("license_audit",), {"sources_used": [{"source_slug": s, "license": x, "redistribute": r} for s, x, r in used], "evidence_safe_to_publish": claim, "non_redistributable_reason": why}) for used, claim, why in _AUDITS]
    d = documents.resafe(documents.checked(faulty(spark, sf_dir, ATTESTATION, faults), "doc_id", "json", "attestation"))
    return d.select("doc_id", F.col("doc.license_audit.evidence_safe_to_publish").alias("safe"), F.col("doc.license_audit.non_redistributable_reason").alias("reason"))


@query("tradition_slugs", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'reformed' ELSE 'eastern-orthodox' END || CASE WHEN c_nationkey % 2 = 0 THEN ',other' ELSE '' END AS slugs FROM customer")
def tradition_slugs(spark, sf_dir):
    """Names as people write them, unknown ones and repeats among them."""
    c = table(spark, sf_dir, "customer")
    first = F.when(F.col("c_custkey") % 3 == 0, " Reformed ").otherwise("Eastern Orthodox")
    names = F.array(first, F.col("c_mktsegment"), F.lower(F.trim(first)), F.when(F.col("c_nationkey") % 2 == 0, "OTHER").otherwise("others"))
    return c.select("c_custkey", F.array_join(documents.traditions(names), ",").alias("slugs"))


@query("named_entities", "SELECT o_orderkey, array_to_string(list_filter(['census', 'the Baptist', 'Pilate', 'Herod', 'Christ'], lambda e: (e = 'Herod' AND o_orderkey % 2 = 0) OR (e = 'Pilate' AND o_orderkey % 3 = 0) OR (e = 'Christ' AND o_orderkey % 5 = 0) OR (e = 'census' AND o_orderkey % 7 = 0) OR (e = 'the Baptist' AND o_orderkey % 11 = 0)), ',') AS entities FROM orders")
def named_entities(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.concat_ws(" ", F.when(k % 5 == 0, "CHRIST"), F.when(k % 2 == 0, "king herod"), F.when(k % 3 == 0, "Under PILATE"), F.when(k % 7 == 0, "a Census"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(documents.entities(said, F.when(k % 11 == 0, "The Baptist"), F.col("o_orderpriority")), ",").alias("entities"))


@query("coerced_tags", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 1 ELSE 0 END + 1 AS n, CASE WHEN event_id % 4 < 2 THEN event_type ELSE 'last' END AS first FROM events")
def coerced_tags(spark, sf_dir):
    """Tags as JSON texts; broken ones and those that are no objects are left out."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    own = F.to_json(F.struct(F.col("event_type").alias("stance"), F.lit(0.5).alias("confidence")))
    t = documents.tags(F.array(F.when(k < 2, own).when(k == 2, "{broken").otherwise("[1, 2]"), F.lit('"text"'), F.lit('{"stance": "last", "confidence": 1}')))
    return e.select("event_id", F.size(t).alias("n"), F.get(t, F.lit(0))["stance"].alias("first"))


@query("verse_bounds", "SELECT o_orderkey, CASE WHEN b < 3 THEN c BETWEEN 1 AND 5 AND v BETWEEN 1 AND 10 + b * c ELSE c >= 1 AND v >= 1 END AS ok FROM (SELECT o_orderkey, o_custkey % 4 AS b, o_orderkey % 8 AS c, o_orderkey % 19 AS v FROM orders)")
def verse_bounds(spark, sf_dir):
    """Verses against a dimension of chapter lengths; one book in four has none."""
    n = table(spark, sf_dir, "nation").where("n_nationkey < 15").select(F.concat(F.lit("B"), F.col("n_nationkey") % 3).alias("book"), (F.floor(F.col("n_nationkey") / 3) + 1).alias("chapter"))
    lengths = n.withColumn("verses", 10 + F.substring("book", 2, 1).cast("int") * F.col("chapter"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("B"), F.col("o_custkey") % 4).alias("book"), (F.col("o_orderkey") % 8).alias("chapter"), (F.col("o_orderkey") % 19).alias("verse"))
    return invariants.in_bounds(o, lengths).select("o_orderkey", "ok")


@query("digit_numbers", "SELECT c_custkey, try_cast(nullif(regexp_replace(c_name, '\\D', '', 'g'), '') AS BIGINT) AS n, try_cast(nullif(regexp_replace(c_mktsegment, '\\D', '', 'g'), '') AS BIGINT) AS none FROM customer")
def digit_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", invariants.digits(F.col("c_name")).alias("n"), invariants.digits(F.col("c_mktsegment")).alias("none"))


@query("source_profile", "SELECT coalesce(nullif(o_orderstatus, 'P'), '') AS source_type, count(*) AS n, count(DISTINCT o_custkey) AS works FROM orders GROUP BY 1")
def source_profile(spark, sf_dir):
    return invariants.profile(table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("source_type"), F.col("o_custkey").alias("work_id")))


@query("question_index", "SELECT v.vec_id::VARCHAR AS question_id, coalesce(d.text, '') AS statement, len(embedding) AS dimension, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings v LEFT JOIN documents d ON d.doc_id = v.vec_id")
def question_index(spark, sf_dir):
    """Statements and vectors of questions, joined by their ids."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("question_id"), F.col("embedding").alias("vector"))
    q = e.select("question_id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("question_id"), F.col("text").alias("statement")), "question_id", "left")
    i = invariants.question_index(q, e)
    return i.select("question_id", "statement", "dimension", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("graph_invariants", """SELECT * FROM (VALUES ('orphan_free[Part]', true), ('orphan_free[Supplier]', true)) AS t(name, ok) WHERE false UNION ALL
 SELECT 'orphan_free[Part]', (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) = 0 UNION ALL SELECT 'orphan_free[Region]', false UNION ALL SELECT 'lemma_distinct_per_strong', (SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 1)) = 0
 UNION ALL SELECT 'instance_of_no_self_loops', true UNION ALL SELECT 'gloss_coverage', (SELECT count(*) FROM part WHERE p_size = 1) = 0 UNION ALL SELECT 'edge_floor[INSTANCE_OF]', (SELECT count(*) FROM lineitem) >= 1000 UNION ALL SELECT 'edge_floor[NOTHING]', false
 UNION ALL SELECT 'no_placeholder[p0]', (SELECT count(*) FROM part WHERE p_partkey = 0) = 0""")
def graph_invariants(spark, sf_dir):
    """Orphans, repeats, loops, glosses, floors and placeholders of a graph of order lines and parts."""
    p = table(spark, sf_dir, "part")
    ident = lambda mark, c: F.concat(F.lit(mark), c)
    edges = table(spark, sf_dir, "lineitem").select(ident("o", "l_orderkey").alias("src_id"), ident("p", "l_partkey").alias("dst_id"), F.lit("INSTANCE_OF").alias("rel_type"))
    lemmas = p.select(ident("p", "p_partkey").alias("id"), F.col("p_brand").alias("strong"), F.when(F.col("p_size") > 1, F.col("p_name")).alias("gloss"), F.lit("src").alias("source"))
    nodes = {"Part": lemmas.select("id"), "Region": table(spark, sf_dir, "region").select(ident("r", "r_regionkey").alias("id"))}
    return invariants.graph_checks(nodes, edges, lemmas, ["other"], ["p0"], {"INSTANCE_OF": 1000, "NOTHING": 1}).select("name", "ok")


@query("bundle_invariants", """WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT DISTINCT o_orderkey::VARCHAR AS ref, l_linenumber, l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT ref, 'word-completeness' AS name, count(*) FILTER (WHERE l_linenumber = 7) AS missing, 0 AS extra FROM l WHERE l_linenumber = 7 GROUP BY ref UNION ALL SELECT ref, 'lemma-completeness', count(DISTINCT l_partkey), 0 FROM l WHERE l_partkey % 10 = 0 GROUP BY ref
 UNION ALL SELECT o_orderkey::VARCHAR, 'crossref-completeness', 1, 0 FROM o WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey::VARCHAR, 'variant-completeness', 1, 0 FROM o WHERE o_orderkey % 9 = 0 AND o_orderkey % 5 = 0
 UNION ALL SELECT o_orderkey::VARCHAR, 'variant-completeness', 0, 1 FROM o WHERE o_orderkey % 9 = 1 AND o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey::VARCHAR, 'syntactic-completeness', 1, 1 FROM o WHERE o_orderkey % 6 = 0 UNION ALL SELECT '<bundle>', 'scope-flag', 1, 0""")
def bundle_invariants(spark, sf_dir):
    """A bundle with words, lexemes, references, variants and clauses lost or added, checked against its sources."""
    ref, k = F.col("o_orderkey").cast("string").alias("ref"), F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    li = o.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == k)
    words, strongs = li.select(ref, "l_linenumber", "l_partkey"), li.select(ref, F.col("l_partkey").cast("string").alias("strong")).distinct()
    p = table(spark, sf_dir, "part").where("p_partkey % 10 > 0").select(F.col("p_partkey").cast("string").alias("strong"), F.when(F.col("p_size") > 5, F.col("p_name")).alias("lemma"))
    xref = lambda n: o.select(ref, n.alias("n"))
    clause = lambda c: o.select(ref, c.alias("clause"))
    source = {"words": words, "syntax": clause(F.lit("c1")), "strongs": strongs, "lemmas": p, "xrefs": xref(F.lit(50) + k % 30), "variants": o.where("o_orderkey % 9 = 0").select(ref, F.lit("v").alias("variant"))}
    shown = F.least(F.lit(60), F.lit(50) + k % 30) - F.when(k % 4 == 0, 1).otherwise(0)
    bundle = {"words": words.where("l_linenumber <> 7"), "syntax": clause(F.when(k % 6 == 0, "c2").otherwise("c1")), "lemmas": p, "xrefs": xref(shown), "variants": o.where("o_orderkey % 9 = 1").select(ref, F.lit("v").alias("variant"))}
    return invariants.bundle_checks(o.select(ref), source, bundle, F.col("ref").cast("long") % 5 == 0, True).select("ref", "name", "missing", "extra")


@query("historical_gate", f"""WITH d AS (SELECT doc_id, doc_id % {len(ATTESTATION_FAULTS)} AS k FROM documents)
SELECT 'coverage' AS name, false AS ok UNION ALL SELECT 'schema_valid', (SELECT count(*) FROM d WHERE k NOT IN (0, {len(ATTESTATION_FAULTS) - 1})) = 0 UNION ALL SELECT 'id_equals_question_id', (SELECT count(*) FROM d WHERE k = 4) = 0 UNION ALL SELECT 'safe_flag_derivation', true
 UNION ALL SELECT 'dash_discipline', (SELECT count(*) FROM d WHERE k = {[n for n, _, _ in ATTESTATION_FAULTS].index('no_dashes')}) = 0 UNION ALL SELECT 'chunks', true UNION ALL SELECT 'parity', (SELECT count(*) FROM documents) = (SELECT count(*) FROM embeddings)""")
def historical_gate(spark, sf_dir):
    files = faulty(spark, sf_dir, ATTESTATION, ATTESTATION_FAULTS)
    asked = files.select("question_id").unionByName(spark.createDataFrame([("doc-none",)], "question_id string"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_type"))
    return invariants.historical_gate(asked, files, chunks, table(spark, sf_dir, "embeddings")).select("name", "ok")


@query("bundle_digest", "SELECT 'customer' AS section, count(*) AS n, true AS same FROM customer UNION ALL SELECT 'part', count(*), true FROM part")
def bundle_digest(spark, sf_dir):
    """Two runs over the same rows in another order and partitioning agree, section by section."""
    b = {name: table(spark, sf_dir, name) for name in ("customer", "part")}
    other = {k: df.repartition(5, df.columns[-1]) for k, df in b.items()}
    x, y = invariants.digest(b), invariants.digest(other).withColumnRenamed("digest", "again").drop("n")
    return x.join(y, "section").select("section", "n", (F.col("digest") == F.col("again")).alias("same"))


@query("subset_test", "SELECT o_orderkey, NOT (o_orderkey % 3 = 0) AS inside FROM orders")
def subset_test(spark, sf_dir):
    k = F.col("o_orderkey")
    a = F.array(F.col("o_orderstatus"), F.when(k % 3 == 0, "x").otherwise("y"))
    return table(spark, sf_dir, "orders").select("o_orderkey", invariants.subset(a, F.array(F.col("o_orderstatus"), F.lit("y"), F.lit("z"))).alias("inside"))
