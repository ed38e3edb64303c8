"""The query surface: each tool as a DataFrame plan over engine tables, for many requests at once.

A response table has the request's key, result columns, and ``audit`` (the licence envelope). Numbers that a caller
gives are checked before a plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import licence, refs, text
from quillgraph.operators import documents, graph, ordered, retrieval, substrings, verdict
from quillgraph.operators.checks import bounds
from quillgraph.plans.registry import stored

QUESTION_ID = "^[a-z0-9][a-z0-9-]*$"


def sources(*pairs: tuple[str, str]) -> Column:
    return F.array(*(F.struct(F.lit(s).alias("source"), F.lit(x).alias("license")) for s, x in pairs)) if pairs else F.array().cast("array<struct<source:string,license:string>>")


def answered(df: DataFrame, used: Column, context: str = "personal", n_words: Column | int = 0, source_words: Column | int = 0) -> DataFrame:
    """``df`` with its licence audit."""
    return df.withColumn("audit", licence.envelope(used, F.lit(context), n_words, source_words))


@dataclass
class Lexical:
    """Tables of the lexical store. Cultural tables live elsewhere and never meet these in one retrieval."""

    verses: DataFrame  # id, osis, text, canon_section
    lemmas: DataFrame  # id, strong, lemma (both languages' labels in one table)
    entries: DataFrame  # base_strong, strong_disambig, greek, hebrew, transliteration, english
    words: DataFrame  # id, source, strong, lemma, surface, morph, verse_id
    tokens: DataFrame  # id, source, strong, surface, morph, verse_id
    edges: DataFrame  # src_id, dst_id, rel_type, votes
    crossrefs: DataFrame  # from_ref, to_ref, votes
    domains: DataFrame | None = None  # strong, lemma, domain_code: a row for each word in a semantic domain
    units: DataFrame | None = None  # id, book, chapter, verse: variant units
    readings: DataFrame | None = None  # id, unit_id, text
    phrases: DataFrame | None = None  # id, clause_id, clause, phrase, function, verse_id: a row for each word of a phrase


def occurrences(lex: Lexical, fixed: bool = True) -> DataFrame:
    """(strong, occurrences_in_canon): tokens and words of each lexeme.

    ``fixed`` adds both counts; otherwise two equal counts count once, as a UNION of them does.
    """
    a = lex.tokens.groupBy("strong").agg(F.count(F.lit(1)).alias("n"))
    b = lex.words.groupBy("strong").agg(F.count(F.lit(1)).alias("n"))
    both = a.unionByName(b) if fixed else a.unionByName(b).distinct()
    return both.groupBy("strong").agg(F.sum("n").alias("occurrences_in_canon"))


def lexical_lookup(lex: Lexical, query: str, id_type: str, limit: int = 20, context: str = "personal", fixed: bool = True) -> DataFrame:
    """Lexemes by code, lemma, surface or gloss: strong, lemma, transliteration, gloss, occurrences, truncated."""
    bounds("limit", limit, 1, 200)
    entry = ["greek", "hebrew", "transliteration", "english"]
    if id_type in ("strong", "lemma"):
        hit = lex.lemmas.where(F.col(id_type) == query).select("strong", "lemma")
    elif id_type == "surface":
        hit = lex.words.where(F.col("surface") == query).select("strong", "lemma")
    elif id_type == "gloss":
        found = lex.entries.where(F.contains("english", F.lit(query))).select(F.col("base_strong").alias("strong")).distinct()
        hit = graph.first_match(found, lex.lemmas.select("strong", "lemma"), "strong", ["lemma"], "lemma")
    else:
        raise ValueError(f"unknown id_type {id_type!r}")
    one = hit.where("strong IS NOT NULL").groupBy("strong").agg(F.min("lemma").alias("raw"))
    lexed = graph.first_match(one, lex.entries.withColumnRenamed("base_strong", "strong"), "strong", entry, "strong_disambig")
    top = lexed.orderBy("strong").limit(limit)  # before the counts, so that only these are counted
    n = occurrences(lex, fixed).join(F.broadcast(top.select("strong")), "strong", "left_semi")
    out = top.join(n, "strong", "left").select("strong", F.coalesce("greek", "hebrew", "raw").alias("lemma"), "transliteration", F.col("english").alias("gloss"), F.coalesce("occurrences_in_canon", F.lit(0)).alias("occurrences_in_canon"))
    out = out.withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))) >= limit)
    return answered(out, sources(("STEPBible-TBESH" if query[:1] == "H" else "STEPBible-TBESG", "CC-BY-4.0")), context)


def concordance_walk(lex: Lexical, anchor: str, limit: int = 200, filter_book: list[str] | None = None, window: int = 0, filter_first: bool = False) -> DataFrame:
    """Occurrences of a code: tok, ref, surface, morph, context_left, context_right.

    The book filter applies after the limit, as callers are used to; ``filter_first`` puts it before. With ``window``
    the words around each occurrence in its verse are given.
    """
    bounds("limit", limit, 1, 2000)
    bounds("window", window, 0, 30)
    both = lex.tokens.where(F.col("strong") == anchor).select(F.col("id").alias("tok"), "verse_id", "surface", "morph").distinct()
    both = both.unionByName(lex.words.where(F.col("strong") == anchor).select(F.col("id").alias("tok"), "verse_id", "surface", "morph")).distinct()
    rows = both.join(lex.verses.select(F.col("id").alias("verse_id"), F.col("osis").alias("ref"), F.col("text").alias("__v")), "verse_id")
    in_book = F.lit(True)
    if filter_book:
        in_book = F.lit(False)
        for b in filter_book:
            in_book = in_book | F.col("ref").startswith(f"{b}.")
    rows = rows.where(in_book) if filter_first else rows
    rows = rows.orderBy("tok").limit(limit).where(in_book)
    left, right = F.lit(""), F.lit("")
    if window:
        w = text.words(F.col("__v"))
        at = F.array_position(w, F.col("surface")).cast("int")
        left = F.when(at > 1, F.array_join(F.slice(w, F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window))), " ")).otherwise("")
        right = F.when(at > 0, F.array_join(F.slice(w, at + 1, window), " ")).otherwise("")
    return rows.select("tok", "ref", F.coalesce("surface", F.lit("")).alias("surface"), F.coalesce("morph", F.lit("")).alias("morph"), left.alias("context_left"), right.alias("context_right"))


def cross_ref(lex: Lexical, anchors: DataFrame, limit: int = 50, min_votes: int | None = None, from_sources: list[str] | None = None) -> DataFrame:
    """References of each ref in ``anchors``: ref, to_ref, source, votes; most votes first."""
    bounds("limit", limit, 1, 500)
    e = lex.edges.where("rel_type = 'OPENBIBLE_CROSS_REF'").select(F.substring_index("src_id", "verse:", -1).alias("ref"), F.substring_index("dst_id", "verse:", -1).alias("to_ref"), F.lit("openbible").alias("source"), F.coalesce("votes", F.lit(1)).cast("long").alias("votes"))
    c = lex.crossrefs.select(F.col("from_ref").alias("ref"), "to_ref", F.lit("tsk").alias("source"), F.coalesce("votes", F.lit(1)).cast("long").alias("votes"))
    both = e.unionByName(c).distinct().join(anchors.select("ref").distinct(), "ref", "left_semi")
    both = both.where(F.col("votes") >= min_votes) if min_votes is not None else both
    both = both.where(F.col("source").isin(*from_sources)) if from_sources is not None else both
    return retrieval.top(both, ["ref"], limit, F.col("votes").desc(), F.col("to_ref"), F.col("source"))


def variant_inspect(requests: DataFrame) -> DataFrame:
    """No critical edition is published for these refs yet: every answer says so."""
    return requests.select("ref", F.lit(False).alias("ecm_published"), F.array().cast("array<string>").alias("variant_units"))


def parallel_translation(lex: Lexical, requests: DataFrame, codes: list[str]) -> DataFrame:
    """(ref, translation, text, lang): the original where there is one, and a pending row for each code."""
    v = requests.select("ref").join(lex.verses.select(F.col("osis").alias("ref"), "text", "canon_section"), "ref").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    original = v.select("ref", F.lit("original").alias("translation"), "text", F.when(F.col("canon_section") == "OT", "hb").otherwise("gk").alias("lang"))
    pending = requests.select("ref", F.explode(F.array(*map(F.lit, codes)).cast("array<string>")).alias("translation"))
    return original.unionByName(pending.select("ref", "translation", F.concat(F.lit("(translation lookup pending for "), "translation", F.lit(")")).alias("text"), F.lit(None).cast("string").alias("lang")))


def versification_resolve(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(ref, from_scheme, to_scheme, to_ref, rule_type, block_scope, inverse): the first rule, else the ref itself."""
    first = rules.groupBy("from_scheme", "from_ref", "to_scheme").agg(F.min_by(F.struct("to_ref", "rule_type", "block_scope"), "line_no").alias("r"))
    j = requests.join(first.withColumnRenamed("from_ref", "ref"), ["from_scheme", "ref", "to_scheme"], "left")
    to = F.coalesce("r.to_ref", "ref")
    inverse = F.struct(F.col("to_scheme").alias("from_scheme"), to.alias("from_ref"), F.col("from_scheme").alias("to_scheme"), F.col("ref").alias("to_ref"))
    return j.select("ref", "from_scheme", "to_scheme", to.alias("to_ref"), F.coalesce("r.rule_type", F.lit("identity")).alias("rule_type"), F.coalesce("r.block_scope", F.lit("")).alias("block_scope"), inverse.alias("inverse"))


#: Words of a work whose length isn't known.
SOURCE_WORDS = 100_000


def retrieve_chunks(queries: DataFrame, chunks: DataFrame, k: int, traditions: list[str] | None = None) -> DataFrame:
    """Top chunks of each query (query_id, vector, doctrine): the tradition filter reaches the scan, the stance is the
    best tag's for the query's doctrine."""
    bounds("k", k, 1, 50)
    c = chunks.where(F.col("tradition").isin(*traditions)) if traditions else chunks
    hits = retrieval.dense(queries, c.select(F.col("chunk_id").alias("id"), "vector"), k)
    rows = hits.withColumnRenamed("id", "chunk_id").join(c.drop("vector"), "chunk_id")
    rows = rows.join(queries.select("query_id", "doctrine"), "query_id")
    tag = verdict.best_tag(F.col("doctrine_tags"), F.col("doctrine"))
    return rows.select("query_id", "rank", "score", "chunk_id", "tradition", F.coalesce("work_title", "work_id", F.lit("<unknown>")).alias("source"), tag["stance"].alias("stance"), "text", F.coalesce("license", F.lit("<unknown>")).alias("license"), F.coalesce("redistribute", F.lit(False)).alias("redistribute"), F.coalesce("source_work_word_count", F.lit(SOURCE_WORDS)).alias("source_words"))


def cultural_overlay(hits: DataFrame, context: str = "personal") -> DataFrame:
    """(query_id, passages, by_tradition, audit): redacted passages, grouped by tradition, with the licence audit."""
    free = F.col("redistribute")
    snip = F.when(free, F.col("text")).otherwise(F.nullif(text.snippet(F.col("text"), F.col("source_words")), F.lit("")))
    p = hits.withColumn("p", F.struct("rank", F.coalesce("tradition", F.lit("unknown")).alias("tradition"), "source", "stance", snip.alias("snippet"), F.when(~free, text.paraphrase(F.col("text"))).alias("paraphrase"), "license"))
    g = p.groupBy("query_id").agg(F.sort_array(F.collect_list("p")).alias("passages"), F.max("source_words").alias("sw"))
    names = F.array_distinct(F.transform("passages", lambda x: x["tradition"]))
    by = F.map_from_arrays(names, F.transform(names, lambda t: F.filter("passages", lambda x: x["tradition"] == t)))
    n = F.aggregate(F.transform("passages", lambda x: text.word_count(x["snippet"])), F.lit(0), lambda a, x: a + x)
    used = F.transform("passages", lambda x: F.struct(F.coalesce(x["source"], F.lit("<unknown>")).alias("source"), x["license"].alias("license")))
    return answered(g.withColumn("by_tradition", by).withColumn("n", n), used, context, F.col("n"), F.col("sw")).select("query_id", "passages", "by_tradition", "audit")


def debate_for_verse(requests: DataFrame, chunks: DataFrame, context: str = "personal", k: int = 12) -> DataFrame:
    """The overlay of each request's first doctrine (the others are not searched)."""
    first = requests.withColumn("doctrine", F.get("doctrines", F.lit(0)))
    return cultural_overlay(retrieve_chunks(first.select("query_id", "vector", "doctrine"), chunks, k), context)


def inspect(requests: DataFrame, stored: DataFrame, schema: str) -> DataFrame:
    """(question_id, error, doc): the parsed JSON document, or which error: invalid_question_id, missing, corrupt."""
    j = requests.join(stored.select("question_id", "json"), "question_id", "left")
    ok = F.col("question_id").rlike(QUESTION_ID)
    doc = F.from_json("json", schema, {"mode": "PERMISSIVE"})
    broken = F.try_parse_json("json").isNull()
    error = F.when(~ok, "invalid_question_id").when(F.col("json").isNull(), "missing").when(broken, "corrupt")
    return j.select("question_id", error.alias("error"), F.when(error.isNull(), doc).alias("doc"))


def historical_inspect(requests: DataFrame, attestations: DataFrame, full: bool = True) -> DataFrame:
    """(question_id, error, doc, sources): the attestation, which must hold every rule of its kind to be read.

    error: invalid_question_id, historical_missing, or historical_corrupt for text that is no JSON or breaks a rule. Without ``full``
    a document is its question, whether there is an attestation, summary and flags.
    """
    j = requests.join(documents.checked(attestations.select("question_id", "json"), "question_id", "json", "attestation"), "question_id", "left")
    error = F.when(~F.col("question_id").rlike(QUESTION_ID), "invalid_question_id").when(F.col("json").isNull(), "historical_missing").when(F.size("_violations") > 0, "historical_corrupt")
    doc = F.col("doc") if full else F.struct(*(F.col(f"doc.{c}").alias(c) for c in ("question_id", "attestation_present", "summary", "flags")))
    used = F.transform("doc.license_audit.sources_used", lambda s: F.struct(F.coalesce(s["source_slug"], F.lit("<unknown>")).alias("source"), F.coalesce(s["license"], F.lit("<unknown>")).alias("license")))
    return j.select("question_id", error.alias("error"), F.when(error.isNull(), doc).alias("doc"), F.when(error.isNull(), used).alias("sources"))


def license_audit(requests: DataFrame) -> DataFrame:
    """(request_id, per_source, redistributable): each source under bulk use; no sources are not redistributable."""
    each = F.transform("sources", lambda s: F.struct(s["source"].alias("source"), licence.guard(s["license"], "bulk").alias("bulk")))
    return requests.select("request_id", each.alias("per_source"), licence.rollup(F.col("sources"), False).alias("redistributable"))


def classify(propositions: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, matched, confidence): vectors if both tables have them, else keywords."""
    if "vector" in propositions.columns and "vector" in questions.columns:
        ranked = retrieval.dense_leading(propositions, questions.select(F.col("question_id").alias("id"), "vector"), F.col("id").startswith("doc-"))
        return retrieval.assess(ranked.withColumn("score", F.round("score", 4)), "semantic")
    q = propositions.select("query_id", text.keywords(F.col("proposition")).alias("tokens"))
    d = questions.select(F.col("question_id").alias("id"), text.keywords(F.concat_ws(" ", "statement", F.translate("question_id", "-", " "))).alias("tokens"))
    ranked = retrieval.leading(retrieval.keyword_rank(q, d), F.col("id").startswith("doc-"))
    # queries that share no word with any question match none
    found = retrieval.assess(ranked, "keyword")
    return q.select("query_id").join(found, "query_id", "left").select("query_id", "matched", F.coalesce("confidence", F.lit("none")).alias("confidence"))


#: What verdicts and bands are called for readers.
ANSWERS = {"true": "Yes, the text affirms this.", "false": "No, the text does not support this.", "null": "The text is silent on this.", "disputed": "The text can be read both ways."}


def doctrinal_verdict(propositions: DataFrame, questions: DataFrame, evidence: DataFrame, overlay: DataFrame | None = None, history: DataFrame | None = None, context: str = "personal") -> DataFrame:
    """The matched question's verdict with its diagnostics as sibling columns; they never change it.

    evidence: (question_id, affirms, breadth, summary, sources); overlay: result of ``cultural_overlay``; history:
    (question_id, witnesses array of struct(witness_id, confidence)).
    """
    match = classify(propositions, questions)
    out = match.join(evidence.withColumnRenamed("question_id", "matched"), "matched", "left")
    names = F.create_map(*[F.lit(x) for kv in ANSWERS.items() for x in kv])
    error = F.when(F.col("matched").isNull(), "no_matching_question").when(F.col("affirms").isNull(), "evidence_missing")
    out = out.withColumn("error", error).withColumn("answer", F.try_element_at(names, "affirms"))
    out = answered(out, F.coalesce("sources", sources()), context)
    out = out.select("query_id", "matched", "confidence", "error", F.col("affirms").alias("verdict"), "answer", "breadth", F.col("summary").alias("explanation"), "audit")
    if overlay is not None:
        counts = overlay.select("query_id", F.explode("passages").alias("p")).select("query_id", "p.tradition", "p.stance", "p.source", "p.rank")
        s = verdict.stance_counts(counts, ["query_id"], "source", ["rank"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("stance", "n", "examples"))).alias("cultural"))
        out = out.join(s, "query_id", "left")
    if history is not None:
        ranked = F.transform("witnesses", lambda w, i: F.struct((-w["confidence"]).alias("o"), i.alias("i"), w["witness_id"].alias("w")))
        h = history.select(F.col("question_id").alias("matched"), F.size("witnesses").alias("witness_count"), F.transform(F.slice(F.sort_array(ranked), 1, 2), lambda x: x["w"]).alias("top_witnesses"))
        out = out.join(h, "matched", "left")
    return out


#: The stretch that has a critical apparatus, and how many rows a part of the bundle may have.
APPARATUS = ("3John", 1, 1, 15)
MOST = {"neighbor": 15, "variant": 10, "syntax": 20}


def neighbours(domains: DataFrame, top: DataFrame, most: int, anchors: int) -> DataFrame:
    """(question_id, code, strong, lemma, rank): lexemes of the anchors' domains that are no anchors; top: (question_id, strong)."""
    named = domains.where("strong IS NOT NULL AND domain_code IS NOT NULL").groupBy(F.col("domain_code").alias("code"), "strong").agg(F.min("lemma").alias("lemma"))
    size = named.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    own = top.select("question_id", "strong").join(named.select("code", "strong"), "strong").groupBy("question_id", "code").agg(F.count(F.lit(1)).alias("own"))
    # domains come in order, so once those before hold enough lexemes that are no anchors, a question needs no further one; of a domain
    # it needs what is missing, and as many more as it has anchors there
    free = own.join(size, "code").withColumn("free", F.col("n") - F.col("own")).where("free > 0")
    before = F.coalesce(F.sum("free").over(W.partitionBy("question_id").orderBy("code").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    codes = free.withColumn("before", before).where(F.col("before") < most).select("question_id", "code", (most - F.col("before") + F.col("own")).alias("take"))
    first = retrieval.top(named, ["code"], most + anchors, F.col("strong"))
    near = codes.join(first, "code").where(F.col("rank") <= F.col("take")).drop("rank", "take").join(top.select("question_id", "strong"), ["question_id", "strong"], "left_anti")
    return retrieval.top(near, ["question_id"], most, F.col("code"), F.col("strong"))


def variants(units: DataFrame, readings: DataFrame, at: DataFrame, most: int) -> DataFrame:
    """(question_id, ref, id, readings, rank): units of the verses in ``at`` (question_id, ref), by book, chapter and verse."""
    p = refs.parts(F.col("ref"))
    key = at.select("question_id", "ref", p["book"].alias("book"), p["chapter"].alias("chapter"), p["verse"].alias("verse"))
    found = retrieval.top(key.join(units, ["book", "chapter", "verse"]), ["question_id"], most, F.col("ref"), F.col("id"))
    said = readings.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("witness"), "text"))).alias("readings"))
    return found.join(said, found["id"] == said["unit_id"], "left").select("question_id", "ref", "id", "readings", "rank")


def syntax(phrases: DataFrame, verses: DataFrame, at: DataFrame, most: int) -> DataFrame:
    """(question_id, ref, clause, phrase, function, rank): phrases of each known verse; a verse without one has a row of blanks."""
    of = phrases.select("verse_id", "clause_id", F.col("id").alias("phrase_id"), "clause", "phrase", "function").repartition("verse_id").distinct()
    known = at.join(verses.select(F.col("id").alias("verse_id")).distinct(), "verse_id")
    got = retrieval.top(known.join(of, "verse_id", "left"), ["question_id"], most, F.col("ref"), F.col("clause_id"), F.col("phrase_id"), F.col("phrase"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return got.select("question_id", "ref", blank("clause"), blank("phrase"), blank("function"), "rank")


def lexical_bundle(lex: Lexical, questions: DataFrame, anchors: int = 40, xrefs: int = 20, apparatus: tuple[str, int, int, int] = APPARATUS) -> DataFrame:
    """(question_id, part, key, rank, value): all parts of each question's bundle.

    Parts: ``lemma`` (anchor lexemes, local and canon counts), ``word`` (words of the anchors' verses), ``xref`` (references by votes),
    ``neighbor`` (lexemes that share a domain with an anchor), ``variant`` (units with their readings), ``syntax`` (phrases), and
    ``scope``: whether no anchor lies where there is an apparatus, so that an empty ``variant`` part is known to be no gap.
    questions: (question_id, scripture_anchors array of human refs). All questions go through one plan; a table that the store
    lacks leaves its part out.
    """
    keys = questions.select("question_id", F.explode_outer("scripture_anchors").alias("human")).select("question_id", refs.to_keys(F.col("human")).alias("keys"))
    # an outer explode, as a plain one makes Spark take the keys a second time to leave empty ones out
    r = keys.select("question_id", F.explode_outer("keys").alias("ref")).where("ref IS NOT NULL").distinct()
    # made once, and dealt by verse once for all parts; then each part is dealt by question once, and all its groups and ranks lie in that
    at = stored(r.select("question_id", F.concat(F.lit("verse:"), "ref").alias("verse_id")), "anchored").repartition("verse_id").withColumn("ref", F.substring("verse_id", len("verse:") + 1, 1 << 30))
    every = lex.tokens.select("id", "strong", "verse_id").unionByName(lex.words.select("id", "strong", "verse_id"))
    said = at.join(every, "verse_id").where("strong IS NOT NULL").select("question_id", "strong", "id").repartition("question_id")
    local = said.groupBy("question_id", "strong").agg(F.countDistinct("id").alias("local"))
    top = stored(retrieval.top(local, ["question_id"], anchors, F.col("local").desc(), F.col("strong")), "anchors")
    canon = every.select("strong", "id").where("strong IS NOT NULL").repartition("strong").groupBy("strong").agg(F.countDistinct("id").alias("canon"))
    lemmas = top.join(canon, "strong").select("question_id", F.lit("lemma").alias("part"), F.col("strong").alias("key"), "rank", F.concat_ws("/", F.col("local").cast("string"), F.col("canon").cast("string")).alias("value"))
    x = lex.crossrefs.select(F.concat(F.lit("verse:"), "from_ref").alias("verse_id"), "to_ref", F.coalesce("votes", F.lit(1)).alias("votes"))
    c = at.join(x, "verse_id").select("question_id", "to_ref", "votes").repartition("question_id").groupBy("question_id", "to_ref").agg(F.max("votes").alias("votes"))
    c = retrieval.top(c, ["question_id"], xrefs, F.col("votes").desc(), F.col("to_ref")).select("question_id", F.lit("xref").alias("part"), F.col("to_ref").alias("key"), "rank", F.col("votes").cast("string").alias("value"))
    w = at.join(lex.words.select("id", "verse_id", "surface"), "verse_id", "left")
    w = w.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy("ref", "id"))).select("question_id", F.lit("word").alias("part"), F.coalesce("id", F.concat(F.lit("none:"), "ref")).alias("key"), "rank", F.col("surface").alias("value"))
    row = lambda df, part, key, value: df.select("question_id", F.lit(part).alias("part"), key.alias("key"), "rank", value.alias("value"))
    out = [lemmas, c, w]
    if lex.domains is not None:
        out.append(row(neighbours(lex.domains, top, MOST["neighbor"], anchors), "neighbor", F.concat_ws(":", "code", "strong"), F.col("lemma")))
    if lex.units is not None and lex.readings is not None:
        said = F.array_join(F.transform("readings", lambda r: F.concat_ws("=", r["witness"], r["text"])), "; ")
        out.append(row(variants(lex.units, lex.readings, at, MOST["variant"]), "variant", F.concat_ws(" ", "ref", "id"), F.coalesce(said, F.lit(""))))
    if lex.phrases is not None:
        out.append(row(syntax(lex.phrases, lex.verses, at, MOST["syntax"]), "syntax", F.col("ref"), F.concat_ws(" | ", "clause", "phrase", "function")))
    inside = at.select("question_id", F.coalesce(refs.in_scope(F.array("ref"), *apparatus), F.lit(False)).alias("inside"))
    inside = inside.unionByName(questions.select("question_id", F.lit(False).alias("inside"))).groupBy("question_id").agg(F.max("inside").alias("inside"))
    outside = inside.select("question_id", F.lit("scope").alias("part"), F.lit("not_in_ecm_scope").alias("key"), F.lit(1).alias("rank"), (~F.col("inside")).cast("string").alias("value"))
    return reduce(DataFrame.unionByName, [*out, outside])


def historical_bundle(queries: DataFrame, chunks: DataFrame, types: list[str], terms: DataFrame, each: int = 6, most: int = 56) -> DataFrame:
    """(query_id, type, id, leg, rank): the nearest chunks of each type, then chunks that name a term, capped.

    chunks: (chunk_id, source_type, text, vector); terms: (query_id, term), any number.
    """
    near = retrieval.dense_by_group(queries, chunks.select(F.col("chunk_id").alias("id"), F.col("source_type").alias("type"), "vector"), "type", each).select("query_id", "type", "id", "rank")
    low = chunks.select(F.col("chunk_id").alias("id"), F.col("source_type").alias("type"), F.lower("text").alias("text"))
    asked = terms.select("query_id", F.lower("term").alias("term")).distinct()
    named = substrings.contained(low, asked).join(asked, "term").select("query_id", "type", "id").distinct()
    named = named.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "type").orderBy("id")))
    return retrieval.balanced(near, named, types, each, most)


def witness_rows(units: DataFrame, witnesses: DataFrame, attested: DataFrame) -> DataFrame:
    """Every witness at every unit; those not attested have a lacuna."""
    return graph.completed(units, witnesses, attested, F.lit("lac"))


def numbered(chunks: DataFrame, anchor: str) -> DataFrame:
    """Chunks in order, with anchors ``<anchor>.001`` and on."""
    n = ordered.position(chunks, ["work_id"], ["at"], "k")
    return n.withColumn("anchor_id", F.concat(F.lit(f"{anchor}."), ordered.padded(F.col("k"), 3))).drop("k")
