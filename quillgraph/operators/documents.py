"""Evidence and attestation documents: their schemas, their rules as Columns, and what is derived anew.

Documents are JSON text; a rule is a name and a Column over the parsed document ``d``. A rule that can't be told to hold
(as its field is missing) doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import licence, text

Rules = list[tuple[str, Column]]

EVIDENCE = (
    "`$schema_version` string, id string, question_id string, generated_at string, pipeline_version string, model string, "
    "verdict struct<affirms:string,lexical_breadth:string,lexical_directness:string,variant_stability:string,variant_robust:boolean,pan_canonical:boolean,rationale:string>, "
    "lexical_evidence struct<anchor_lemmas:array<struct<strong:string,lemma:string,transliteration:string,occurrences_in_canon:int,in_anchors:boolean>>,concordance_traversed:array<string>,"
    "scripture:array<struct<ref:string,key_terms:array<struct<strong:string,lemma:string>>,reasoning:string,supports:string,genre:string,figures:array<string>>>,"
    "cross_refs_invoked:array<struct<`from`:string,`to`:string,source:string,votes:int>>,complicating_texts:array<struct<ref:string,addressed:boolean,resolution:string>>>, "
    "variants struct<verdict_variant_sensitive:boolean,variant_units_examined:array<struct<ref:string,variant_id:string,verdict_impact:string,note:string>>,ecm_status:string,note:string>, "
    "hermeneutics struct<primary_method:string,analogia_scripturae:boolean,progressive_revelation:boolean,competing_lens_verdicts:array<struct<framework:string,verdict:string,rationale:string>>>, "
    "stem_audit struct<verdict_preloaded:boolean,neutralized_form:string,notes:string>, lay_summary string, "
    "citations array<struct<type:string,source:string,license:string,redistribute:boolean,ref:string>>, "
    "license_audit struct<sources_used:array<struct<source:string,license:string,redistribute:boolean>>,evidence_safe_to_publish:boolean,non_redistributable_reason:string>, flags array<string>"
)
ATTESTATION = (
    "`$schema_version` string, id string, question_id string, generated_at string, pipeline_version string, model string, attestation_present boolean, "
    "witnesses array<struct<witness_id:string,source_type:string,source:struct<source_slug:string,work_id:string,work_title:string,date_written_range:string,anchor_id:string,language:string,edition:string>,"
    "attestation_type:string,confidence:double,evidence_phrase:string,rationale:string,contested_interpolation:struct<type:string,note:string,redact_for_embedding:boolean>,"
    "provenance:struct<original_language:string,witness_chain:array<string>,extant_witnesses:array<string>,loss_status:string>,text:string,text_to_embed:string,license:string,redistribute:boolean,license_note:string>>, "
    "summary string, license_audit struct<sources_used:array<struct<source_slug:string,license:string,redistribute:boolean>>,evidence_safe_to_publish:boolean,non_redistributable_reason:string>, flags array<string>"
)
EVIDENCE_KEYS = [
    "$schema_version", "id", "question_id", "generated_at", "pipeline_version", "model", "verdict", "lexical_evidence", "variants", "hermeneutics",
    "stem_audit", "lay_summary", "citations", "license_audit", "flags",
]
ATTESTATION_KEYS = [
    "$schema_version", "id", "question_id", "generated_at", "pipeline_version", "model", "attestation_present", "witnesses", "summary", "license_audit",
    "flags",
]

#: What fields of evidence documents may hold.
STRONG = "^[HG]\\d{4}[A-Z]?$"
ISO_TIME = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})$"
DASHES = "[–—]"
AFFIRMS = ["true", "false", "disputed"]
BREADTHS = ["canon_wide", "broad", "partial", "thin"]
DIRECTNESS = ["direct", "inferred", "analogical", "silent"]
STABILITIES = ["stable", "sensitive", "not_in_scope"]
SUPPORTS = ["for", "complicates", "neutral"]
GENRES = ["law", "narrative", "wisdom", "prophecy", "gospel", "epistle", "apocalyptic"]
FIGURES = ["metaphor", "simile", "personification", "chiasm", "merism", "idiom", "hyperbole"]
ECM = ["ecm-published", "ecm-shadow", "n/a"]
METHODS = ["grammatico-historical", "redemptive-historical", "quadriga", "patristic-typological", "accommodation"]
CITATIONS = ["morphology", "syntax", "cross_ref", "variant", "interlinear", "lexicon"]
IMPACTS = ["none", "minor", "material"]
FLAGS = ["ecm-shadow", "concordance-thin", "variant-sensitive", "lexically-disputed", "cross-tradition-divergent", "complicating-unresolved"]
SOURCES = [
    "MACULA-Greek", "MACULA-Hebrew", "MACULA-Hebrew-marble-sdbh", "MACULA-Greek-louw-nida", "STEPBible-TAHOT", "STEPBible-TAGNT", "STEPBible-TVTMS",
    "STEPBible-TBESH", "STEPBible-TBESG", "STEPBible-TFLSJ", "OSHB-morphology", "MorphGNT-morphology", "SBLGNT-text", "Nestle1904-text", "ETCBC-BHSA",
    "ETCBC-Peshitta", "ETCBC-syrnt", "ETCBC-DSS", "OpenBible-cross-refs", "TSK", "Theographic-Bible-Metadata", "INTF-NTVMR", "open-cbgm-3-john-sample",
    "BibleHub-interlinear",
]
#: Framings that belong to traditions and not to the text.
FRAMING = (
    "(?i)(historic\\s+christian\\s+position|reformed\\s+teach|catholics?\\s+teach|lutherans?\\s+teach|denominational\\s+landscape|tradition\\s+holds"
    "|the\\s+(catholic|reformed|lutheran|orthodox|anglican|methodist|anabaptist|pentecostal)\\s+church\\s+(teaches|holds|affirms|denies)|by\\s+contrast\\s+the\\s+\\w+\\s+tradition)"
)
#: What fields of attestations may hold.
SOURCE_TYPES = ["jewish-historian", "jewish-philosopher", "second-temple-literature", "roman-historian", "jewish-rabbinic", "qumran-sectarian", "qumran-biblical"]
ATTESTS = ["corroborates", "complicates", "neutral", "parallel", "silent-where-expected"]
CONTESTED = ["none", "partial-interpolation", "recension-layer", "text-critical-variant"]
LOSSES = ["complete", "partial", "fragmentary", "reconstructed", "complete-in-ethiopic", "complete-in-syriac"]
SLUGS = [
    "josephus", "philo", "1enoch", "jubilees", "test12", "2baruch", "4ezra", "pssol", "sibor", "tacitus", "suetonius", "pliny", "mishnah", "1qs", "1qsa",
    "1qsb", "1qm", "1qha", "1qphab", "cd", "11q19", "4qmmt", "1qisaa", "4qsam-a", "4qsam-b", "4qdeut-q", "11qpsa",
]
QUMRAN_SLUG = "(?i)^\\d{1,2}Q[a-z0-9-]+$"
QUMRAN_ANCHOR = "(?i)^\\d{1,2}q[a-z0-9-]+\\.(col\\d+|f[0-9a-z]+(\\.col\\d+)?)\\.line\\d+$"
_VERSES = "^(1enoch|jubilees|2baruch|4ezra|pssol|sibor)\\.\\d+\\.\\d+[a-z]?$"
ANCHORS = {
    "josephus": "^josephus\\.(ant|vita|apion|wars)\\.\\d+\\.\\d+$", "philo": "^philo\\.[a-z0-9-]+\\.\\d+$", "tacitus": "^tacitus\\.annals\\.\\d+\\.\\d+$", "suetonius": "^suetonius\\.[a-z0-9-]+\\.\\d+(\\.\\d+)?$",
    "pliny": "^pliny\\.ep\\.\\d+\\.\\d+(\\.\\d+)?$", "mishnah": "^mishnah\\.[a-z0-9-]+\\.\\d+\\.\\d+$", "1enoch": _VERSES, "jubilees": _VERSES, "2baruch": _VERSES, "4ezra": _VERSES, "pssol": _VERSES, "sibor": _VERSES,
    "test12": "^test12\\.[a-z]+\\.\\d+\\.\\d+[a-z]?$",
}
REGISTERED = {"CC-BY-SA-4.0": True, "PD": True, "CC-BY": True, "CC0": True, "CC-BY-NC-4.0": False}


def _some(c: Column) -> Column:
    """A text that isn't empty."""
    return F.length(c) >= 1


def _each(items: Column, ok) -> Column:
    """All elements are fine; a missing list has none."""
    return F.coalesce(F.forall(items, lambda x: F.coalesce(ok(x), F.lit(False))), items.isNull())


def _plain(c: Column) -> Column:
    """No dashes; a missing text has none."""
    return ~F.coalesce(c, F.lit("")).rlike(DASHES)


def _one_of(c: Column, values: list[str]) -> Column:
    return c.isin(*values)


def safe(audit: Column) -> Column:
    """Whether all sources of a licence audit are free for bulk use; no source hinders nothing."""
    return F.coalesce(F.forall(audit["sources_used"], lambda s: licence.guard(s["license"], "bulk")["allowed"]), F.lit(True))


def evidence_rules(d: Column, json: Column) -> Rules:
    """The rules of an evidence document."""
    v, e, a = d["verdict"], d["lexical_evidence"], d["license_audit"]
    term = lambda t: t["strong"].rlike(STRONG) & _some(t["lemma"])
    return [
        ("schema_version", d["$schema_version"] == "3.1"),
        ("unknown_keys", F.size(schemas.unknown_keys(json, EVIDENCE_KEYS)) == 0),
        ("id", _some(d["id"])),
        ("question_id", _some(d["question_id"])),
        ("id_is_question_id", d["id"] == d["question_id"]),
        ("generated_at", d["generated_at"].rlike(ISO_TIME)),
        ("made_by", _some(d["pipeline_version"]) & _some(d["model"])),
        ("affirms", v.isNotNull() & (v["affirms"].isNull() | _one_of(v["affirms"], AFFIRMS))),
        ("directness", _one_of(v["lexical_directness"], DIRECTNESS)),
        ("breadth", v["lexical_breadth"].isNull() | _one_of(v["lexical_breadth"], BREADTHS)),
        ("stability", v["variant_stability"].isNull() | _one_of(v["variant_stability"], STABILITIES)),
        ("verdict_flags", v["variant_robust"].isNotNull() & v["pan_canonical"].isNotNull()),
        ("rationale", _some(v["rationale"])),
        ("silent_means_null", (v["lexical_directness"] != "silent") | v["affirms"].isNull()),
        ("anchor_lemmas", _each(e["anchor_lemmas"], lambda x: term(x) & _some(x["transliteration"]) & (x["occurrences_in_canon"] >= 0) & x["in_anchors"].isNotNull())),
        ("concordance", _each(e["concordance_traversed"], lambda x: x.rlike(STRONG))),
        ("scripture", _each(e["scripture"], lambda x: _some(x["ref"]) & _some(x["reasoning"]) & (F.size(x["key_terms"]) >= 1) & _each(x["key_terms"], term))),
        ("scripture_kind", _each(e["scripture"], lambda x: _one_of(x["supports"], SUPPORTS) & _one_of(x["genre"], GENRES) & _each(x["figures"], lambda f: _one_of(f, FIGURES)))),
        ("cross_refs", _each(e["cross_refs_invoked"], lambda x: _some(x["from"]) & _some(x["to"]) & x["source"].isin("openbible", "tsk") & (x["votes"] >= 0))),
        ("complicating", _each(e["complicating_texts"], lambda x: _some(x["ref"]) & x["addressed"].isNotNull() & _some(x["resolution"]))),
        ("variants", d["variants"]["verdict_variant_sensitive"].isNotNull() & _one_of(d["variants"]["ecm_status"], ECM)),
        ("variant_units", _each(d["variants"]["variant_units_examined"], lambda x: _some(x["ref"]) & _some(x["variant_id"]) & _one_of(x["verdict_impact"], IMPACTS) & _some(x["note"]))),
        ("method", _one_of(d["hermeneutics"]["primary_method"], METHODS)),
        ("hermeneutics", d["hermeneutics"]["analogia_scripturae"].isNotNull() & d["hermeneutics"]["progressive_revelation"].isNotNull()),
        ("lenses", _each(d["hermeneutics"]["competing_lens_verdicts"], lambda x: _some(x["framework"]) & _some(x["verdict"]) & _some(x["rationale"]))),
        ("stem_audit", d["stem_audit"]["verdict_preloaded"].isNotNull()),
        ("no_dashes", d["lay_summary"].isNotNull() & _plain(d["lay_summary"])),
        ("summary_words", text.word_count(d["lay_summary"]).between(100, 500)),
        ("framing", ~d["lay_summary"].rlike(FRAMING)),
        ("citation_kind", _each(d["citations"], lambda x: _one_of(x["type"], CITATIONS) & _some(x["license"]) & _some(x["ref"]) & x["redistribute"].isNotNull())),
        ("citation_source", _each(d["citations"], lambda x: _one_of(x["source"], SOURCES))),
        ("source_licences", a.isNotNull() & _each(a["sources_used"], lambda s: _some(s["source"]) & (s["redistribute"] == licence.guard(s["license"], "bulk")["allowed"]))),
        ("safe_flag", a["evidence_safe_to_publish"] == safe(a)),
        ("unsafe_reason", safe(a) | _some(a["non_redistributable_reason"])),
        ("flags", _each(d["flags"], lambda f: _one_of(f, FLAGS))),
    ]


def witness_anchor(w: Column) -> Column:
    """Whether a witness's anchor has the form of its source."""
    anchor, slug = w["source"]["anchor_id"], w["source"]["source_slug"]
    by_slug = F.lit(False)
    for name, form in ANCHORS.items():
        by_slug = F.when(slug == name, anchor.rlike(form)).otherwise(by_slug)
    return F.when(w["source_type"].isin("qumran-sectarian", "qumran-biblical"), anchor.rlike(QUMRAN_ANCHOR)).otherwise(by_slug)


def attestation_rules(d: Column, json: Column) -> Rules:
    """The rules of an attestation document."""
    each = lambda ok: _each(d["witnesses"], ok)
    words, present, a = text.word_count(d["summary"]), d["attestation_present"], d["license_audit"]
    n = F.coalesce(F.size(d["witnesses"]), F.lit(0))
    pinned = F.create_map(*(F.lit(x) for kv in REGISTERED.items() for x in kv))
    ids = F.coalesce(F.transform(d["witnesses"], lambda w: w["witness_id"]), F.array().cast("array<string>"))
    contested = lambda w: w["contested_interpolation"]
    return [
        ("schema_version", d["$schema_version"] == "1.0"),
        ("unknown_keys", F.size(schemas.unknown_keys(json, ATTESTATION_KEYS)) == 0),
        ("id_is_question_id", _some(d["id"]) & (d["id"] == d["question_id"])),
        ("made_by", _some(d["generated_at"]) & _some(d["pipeline_version"]) & _some(d["model"])),
        ("presence", present == (n > 0)),
        ("slug", each(lambda w: _one_of(w["source"]["source_slug"], SLUGS) | w["source"]["source_slug"].rlike(QUMRAN_SLUG))),
        ("anchor", each(witness_anchor)),
        ("witness_id", each(lambda w: w["witness_id"] == w["source"]["anchor_id"])),
        ("source", each(lambda w: _one_of(w["source_type"], SOURCE_TYPES) & _some(w["source"]["work_id"]) & _some(w["source"]["work_title"]) & _some(w["source"]["date_written_range"]) & _some(w["source"]["language"]) & _some(w["source"]["edition"]))),
        ("attestation_type", each(lambda w: _one_of(w["attestation_type"], ATTESTS))),
        ("confidence", each(lambda w: w["confidence"].between(0, 1))),
        ("phrase", each(lambda w: _some(w["evidence_phrase"]) & (text.word_count(w["evidence_phrase"]) <= 60) & _some(w["rationale"]))),
        ("contested_note", each(lambda w: _one_of(contested(w)["type"], CONTESTED) & F.when(contested(w)["type"] == "none", contested(w)["note"].isNull()).otherwise(F.trim(contested(w)["note"]) != ""))),
        ("redaction", each(lambda w: ~F.coalesce(contested(w)["redact_for_embedding"], F.lit(False)) | (w["text"] != w["text_to_embed"]))),
        ("provenance", each(lambda w: _some(w["provenance"]["original_language"]) & (F.size(w["provenance"]["witness_chain"]) >= 1) & _each(w["provenance"]["witness_chain"], lambda x: F.trim(x) != "") & _one_of(w["provenance"]["loss_status"], LOSSES))),
        ("texts", each(lambda w: _some(w["text"]) & _some(w["text_to_embed"]))),
        ("licence", each(lambda w: w["redistribute"] == F.try_element_at(pinned, w["license"]))),
        ("summary_words", F.when(present, words.between(50, 300)).otherwise(words <= 300)),
        ("no_dashes", _plain(d["summary"]) & _plain(a["non_redistributable_reason"]) & each(lambda w: _plain(w["evidence_phrase"]) & _plain(w["rationale"]) & _plain(w["license_note"]) & _plain(contested(w)["note"]))),
        ("unique_ids", F.size(F.array_distinct(ids)) == F.size(ids)),
        ("safe_flag", a["evidence_safe_to_publish"].isNotNull() & _each(a["sources_used"], lambda s: _some(s["source_slug"]) & _some(s["license"]) & s["redistribute"].isNotNull())),
    ]


def checked(docs: DataFrame, key: str, json: str, kind: str) -> DataFrame:
    """``docs`` with the parsed document ``doc`` and ``_violations``; text that is no JSON object violates ``json`` alone."""
    schema, rules = {"evidence": (EVIDENCE, evidence_rules), "attestation": (ATTESTATION, attestation_rules)}[kind]
    d = docs.withColumn("doc", F.from_json(json, schema, {"mode": "PERMISSIVE"}))
    broken = F.json_object_keys(F.col(json)).isNull() | F.try_parse_json(json).isNull()
    out = schemas.validated(d, rules(F.col("doc"), F.col(json)))
    return out.withColumn("_violations", F.when(broken, F.array(F.lit("json"))).otherwise(F.col("_violations")))


def resafe(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Attestations with the safe flag that follows from their sources; the reason follows the flag, not what was claimed."""
    a = F.col(doc)["license_audit"]
    now = safe(a)
    unsafe = F.array_sort(F.array_distinct(F.transform(F.filter(a["sources_used"], lambda s: ~s["redistribute"]), lambda s: s["source_slug"])))
    named = F.when(F.size(unsafe) > 0, F.concat(F.lit("Cites a non-redistributable source: "), F.array_join(unsafe, ", "), F.lit("."))).otherwise("Cites a non-redistributable source.")
    reason = F.when(now == a["evidence_safe_to_publish"], a["non_redistributable_reason"]).when(now, F.lit(None)).otherwise(F.coalesce(F.nullif(a["non_redistributable_reason"], F.lit("")), named))
    audit = a.withField("evidence_safe_to_publish", now).withField("non_redistributable_reason", reason)
    return docs.withColumn(doc, F.col(doc).withField("license_audit", audit))


#: Traditions by slug.
TRADITIONS = [
    "patristic", "catholic-magisterial", "eastern-orthodox", "oriental-orthodox", "lutheran", "reformed", "anglican", "methodist", "anabaptist",
    "pentecostal", "plymouth-brethren", "other",
]
#: Names that questions are searched for.
ENTITIES = [
    "Quirinius", "Cyrenius", "census", "John the Baptist", "the Baptist", "Theudas", "Lysanias", "Pilate", "Pontius Pilate", "Herod", "Herodias", "resurrection", "Sanhedrin", "Caiaphas", "Annas",
    "Christ", "Christus", "Chrestus", "Tiberius", "Nazareth", "crucified", "crucifixion", "Messiah",
]
TAG = "doctrine_coarse string, doctrine_fine string, stance string, confidence double, evidence_phrase string"


def traditions(names: Column) -> Column:
    """Known traditions' slugs of an array of names, each once, in order."""
    slugs = F.transform(F.coalesce(names, F.array().cast("array<string>")), text.slugify)
    return F.array_distinct(F.filter(slugs, lambda s: s.isin(*TRADITIONS)))


def entities(*parts: Column) -> Column:
    """Which of ``ENTITIES`` texts name, whatever their case, in the list's order."""
    said = F.lower(F.concat_ws(" ", *parts))
    return F.filter(F.array(*map(F.lit, ENTITIES)), lambda e: F.contains(said, F.lower(e)))


def tags(texts: Column) -> Column:
    """Tags from an array of JSON texts; what is no JSON object is left out."""
    objects = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.json_object_keys(t).isNotNull())
    return F.transform(objects, lambda t: F.from_json(t, TAG))
