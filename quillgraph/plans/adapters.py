"""Adapters as dataflows: files to node, edge and chunk tables. Missing files give an error, never sample rows.

Each is a function of (spark, path) in ``ADAPTERS``; what differs between the confessional works is the table ``WORKS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import refs, strongs, text
from quillgraph.operators import ordered
from quillgraph.sources import markup, textfabric, works
from quillgraph.sources import text as lines

Tables = dict[str, DataFrame]
ADAPTERS: dict[str, Callable[[SparkSession, str], Tables]] = {}


def adapter(f: Callable[[SparkSession, str], Tables]) -> Callable[[SparkSession, str], Tables]:
    ADAPTERS[f.__name__] = f
    return f


def verse_id(osis: Column) -> Column:
    return F.concat(F.lit("verse:"), osis)


def edges(df: DataFrame, src: Column, dst: Column, rel: str, **props: Column) -> DataFrame:
    return df.select(src.alias("src_id"), dst.alias("dst_id"), F.lit(rel).alias("rel_type"), *(c.alias(n) for n, c in props.items())).where("src_id IS NOT NULL AND dst_id IS NOT NULL")


#: Book numbers 01 to 27 of the Greek texts.
GREEK_BOOKS = "Matt Mark Luke John Acts Rom 1Cor 2Cor Gal Eph Phil Col 1Thess 2Thess 1Tim 2Tim Titus Phlm Heb Jas 1Pet 2Pet 1John 2John 3John Jude Rev".split()


@adapter
def morphgnt(spark: SparkSession, path: str) -> Tables:
    """``BBCCVV pos parse text word normalised lemma``: words, verses with their text, IN_VERSE and PARSE_OF edges."""
    r = lines.positional(lines.matching(lines.lines(spark, path), "^\\s*\\d{6}\\s"), ["bcv", "pos", "parse", "surface", "word", "normalized", "lemma"])
    n = lambda a: F.substring("bcv", a, 2).cast("int")
    book = F.get(F.array(*map(F.lit, GREEK_BOOKS)), n(1) - 1)
    r = r.withColumn("osis", F.concat_ws(".", book, n(3).cast("string"), n(5).cast("string"))).where(book.isNotNull())
    r = ordered.position(r, ["osis"], ["file", "line_no"], "at")
    words = r.select(F.concat(F.lit("morphgnt:"), "osis", F.lit("."), ordered.padded(F.col("at"))).alias("id"), F.concat("osis", F.lit("."), ordered.padded(F.col("at"))).alias("osis_wpos"), "osis", "surface", "lemma", "parse", F.col("pos").alias("part_of_speech"))
    verses = ordered.joined_text(r, ["osis"], "at", "surface").select(verse_id(F.col("osis")).alias("id"), "osis", "text", F.lit("NT").alias("canon_section"))
    return {"Word": words, "Verse": verses, "IN_VERSE": edges(words, F.col("id"), verse_id(F.col("osis")), "IN_VERSE"), "PARSE_OF": edges(words, F.col("id"), F.concat(F.lit("macula:"), "osis_wpos"), "PARSE_OF")}


def _brief(spark: SparkSession, path: str, header: str, word: str, lang: str, licence: str) -> Tables:
    names = ["strong_disambig", "dstrong", "base_strong", word, "transliteration", "pos", "english", "definition"]
    r = lines.after_header(lines.lines(spark, path), F.col("line").startswith(header))
    r = lines.fields(r.where(F.contains("line", F.lit("\t"))), names)
    n = r.withColumn("canonical", F.coalesce(strongs.canonical(F.col("base_strong"), F.lit(lang))["canonical"], F.col("base_strong")))
    n = ordered.first_wins(n, ["strong_disambig"], ["file", "line_no"])
    nodes = n.select("strong_disambig", F.col("canonical").alias("base_strong"), text.first_filled(F.col(word), F.col("transliteration"), F.col("strong_disambig")).alias(word), "transliteration", "pos", text.null_if_blank(F.col("english")).alias("english"), "definition", F.lit(licence).alias("license"))
    return {"BriefLexEntry": nodes, "LEX_FOR": edges(nodes, F.col("strong_disambig"), F.col("base_strong"), "LEX_FOR")}


@adapter
def stepbible_tbesh(spark: SparkSession, path: str) -> Tables:
    """Brief Hebrew entries below a prose preamble; base codes are canonical, so lookups by them always join."""
    return _brief(spark, path, "eStrong", "hebrew", "hb", "CC-BY-4.0")


@adapter
def stepbible_tbesg(spark: SparkSession, path: str) -> Tables:
    return _brief(spark, path, "eStrong", "greek", "gk", "CC-BY-4.0")


@adapter
def stepbible_tflsj(spark: SparkSession, path: str) -> Tables:
    r = lines.fields(lines.after_header(lines.lines(spark, path), F.col("line").startswith("eStrong")).where(F.contains("line", F.lit("\t"))), ["strong", "dstrong", "ustrong", "lemma", "transliteration", "pos", "english", "lsj_definition"])
    n = ordered.first_wins(r.withColumn("id", F.concat(F.lit("lsj:"), "strong")), ["id"], ["file", "line_no"])
    n = n.select("id", strongs.canonical(F.col("strong"), F.lit("gk"))["canonical"].alias("strong"), "lemma", text.without_accents("lemma").alias("lemma_unaccented"), "transliteration", "pos", text.null_if_blank(F.col("english")).alias("english"), text.null_if_blank(F.col("lsj_definition")).alias("lsj_definition"))
    return {"LsjEntry": n, "LEX_FOR": edges(n, F.col("id"), F.col("strong"), "LEX_FOR")}


@adapter
def stepbible_morph_codes(spark: SparkSession, path: str) -> Tables:
    """``$``-blocks of a code and what it may mean."""
    r = lines.lines(spark, path)
    cut = lines.blocks(r, F.col("line").startswith("$"))
    code = F.regexp_extract("head", "^\\$\\s*(\\S+)", 1)
    rest = F.trim(F.regexp_replace("head", "^\\$\\s*\\S+\\s*", ""))
    body = F.trim(F.concat_ws(" ", F.when(rest != "", rest), F.array_join(F.filter(F.transform("details", lambda x: F.trim(x)), lambda x: x != ""), " ")))
    n = cut.select(code.alias("code"), body.alias("expansion"), "file", "line_no").where("code <> ''")
    n = ordered.first_wins(n, ["code"], ["file", "line_no"]).select("code", "expansion", F.filter(F.transform(text.alternatives(F.col("expansion")), lambda x: F.trim(x)), lambda x: x != "").alias("expansions"))
    return {"MorphCode": n}


@adapter
def stepbible_tvtms(spark: SparkSession, path: str) -> Tables:
    """Versification rules; exact repeats get an ordinal in their id."""
    r = lines.rule_rows(lines.lines(spark, path)).toDF("file", "line_no", "tradition_a", "ref_a", "tradition_b", "ref_b", "rule_type", "note")
    base = F.concat_ws(":", F.lit("tvtms"), "tradition_a", "ref_a", "tradition_b", "ref_b", "rule_type")
    n = ordered.ordinal_suffix(r.withColumn("base", base), "base", ["file", "line_no"], "id")
    return {"VersificationRule": n.drop("base")}


def english_rules(rules: DataFrame) -> DataFrame:
    """(from_ref, to_ref, line_no) of the rules that start from the English scheme."""
    return rules.where((F.lower(F.trim("tradition_a")) == "english") & (F.trim("ref_a") != "") & (F.trim("ref_b") != "")).select(F.trim("ref_a").alias("from_ref"), F.trim("ref_b").alias("to_ref"), "line_no")


@adapter
def openbible(spark: SparkSession, path: str, rules: DataFrame | None = None, verses: DataFrame | None = None) -> Tables:
    """``from<TAB>to<TAB>votes``: targets that are ranges count as their first verse; rows off the map are quarantined."""
    r = lines.typed(lines.tsv(spark, path, ["from_ref", "to_ref", "votes"]), ["votes"])
    r = r.withColumn("to_head", refs.head(F.col("to_ref")))
    if rules is not None:
        r = ordered.bridged(r.withColumnRenamed("from_ref", "f"), rules, "f", ["line_no"]).withColumnRenamed("mapped", "from_osis")
        r = ordered.bridged(r, rules, "to_head", ["line_no"]).withColumnRenamed("mapped", "to_osis")
    else:
        r = r.withColumn("from_osis", F.col("from_ref")).withColumn("to_osis", F.col("to_head"))
    ok = refs.is_ref(F.col("from_osis")) & refs.is_ref(F.col("to_osis"))
    if verses is not None:
        known = verses.select("osis").distinct()
        r = r.join(known.select(F.col("osis").alias("from_osis"), F.lit(True).alias("k1")), "from_osis", "left").join(known.select(F.col("osis").alias("to_osis"), F.lit(True).alias("k2")), "to_osis", "left")
        ok = ok & F.col("k1").isNotNull() & F.col("k2").isNotNull()
    e = edges(r.where(ok), verse_id(F.col("from_osis")), verse_id(F.col("to_osis")), "OPENBIBLE_CROSS_REF", votes=F.col("votes"))
    return {"OPENBIBLE_CROSS_REF": e, "quarantine": r.where(~ok).select("from_osis", "to_osis", "votes")}


@adapter
def tsk(spark: SparkSession, path: str) -> Tables:
    """``book chapter verse word keyword refs`` in Latin-1: one reference for each target; bad numbers drop the row.

    Targets are joined on the verse id, which both testaments have.
    """
    r = lines.fields(lines.lines(spark, path, "ISO-8859-1"), ["book_num", "chapter", "verse", "word_num", "keyword", "xrefs"])
    r = lines.typed(r, ["book_num", "chapter", "verse", "word_num"])
    books = [*dict.fromkeys(refs.BOOKS.values())]
    book = F.get(F.array(*map(F.lit, books)), F.col("book_num") - 1)
    r = r.withColumn("from_ref", F.concat_ws(".", book, F.col("chapter").cast("string"), F.col("verse").cast("string"))).where(book.isNotNull())
    x = r.select("file", "line_no", "from_ref", "keyword", F.posexplode(F.flatten(F.transform(F.split("xrefs", ";"), refs.expand))).alias("at", "t"))
    x = x.withColumn("to_ref", F.concat_ws(".", "t.book", F.col("t.chapter").cast("string"), F.col("t.verse").cast("string")))
    n = ordered.first_wins(x.withColumn("id", F.concat_ws(":", F.lit("tsk"), "from_ref", "to_ref")).drop("t"), ["id"], ["file", "line_no", "at"])
    n = n.select("id", "from_ref", "to_ref", "keyword", F.lit(1).alias("votes"))
    return {"CrossRef": n, "CROSS_REF": edges(n, F.col("id"), verse_id(F.col("to_ref")), "CROSS_REF")}


@adapter
def peshitta(spark: SparkSession, path: str) -> Tables:
    r = lines.tsv(spark, path, ["verse_ref", "token_pos", "text", "lex", "gloss", "morph"])
    r = ordered.position(r, ["file"], ["line_no"], "k").withColumn("at", F.coalesce(F.col("token_pos").try_cast("int"), F.col("k")))
    n = r.select(F.concat_ws(":", F.lit("peshitta"), "verse_ref", F.col("at").cast("string")).alias("id"), "verse_ref", F.col("at").alias("token_pos"), "text", text.nfc("lex").alias("lex_nfc"), text.null_if_blank(F.col("gloss")).alias("gloss"), "morph", "file", "line_no")
    n = ordered.first_wins(n, ["id"], ["file", "line_no"]).drop("file", "line_no")
    return {"SyriacWord": n, "IN_VERSE": edges(n, F.col("id"), verse_id(F.col("verse_ref")), "IN_VERSE")}


def _tagged(spark: SparkSession, path: str, source: str, lang: str, code: Column, names: list[str]) -> Tables:
    """Rows ``Book.C.V#pos...``: tagged tokens."""
    form = "^([1-3]?[A-Za-z]{2,3}\\.\\d+\\.\\d+)[^#]*#(\\d+)"
    r = lines.fields(lines.matching(lines.lines(spark, path), form), ["ref", *names])
    osis, at = F.regexp_extract("ref", form, 1), F.regexp_extract("ref", form, 2).cast("int")
    n = r.select(F.concat(F.lit(f"{source}:"), osis, F.lit("#"), ordered.padded(at)).alias("id"), osis.alias("osis"), at.alias("pos"), F.col(names[0]).alias("surface"), strongs.canonical(code, F.lit(lang))["canonical"].alias("strong"), F.col(names[-1]).alias("morph"), F.lit(source).alias("source"), "file", "line_no")
    n = ordered.first_wins(n, ["id"], ["file", "line_no"]).drop("file", "line_no")
    return {"TaggedToken": n, "IN_VERSE": edges(n, F.col("id"), verse_id(F.col("osis")), "IN_VERSE"), "INSTANCE_OF": edges(n, F.col("id"), F.col("strong"), "INSTANCE_OF")}


@adapter
def stepbible_tagnt(spark: SparkSession, path: str) -> Tables:
    """Greek tokens; the code is what stands before ``=`` in the grammar column."""
    return _tagged(spark, path, "STEPBible-TAGNT", "gk", F.substring_index("grammar", "=", 1), ["greek", "english", "grammar"])


@adapter
def stepbible_tahot(spark: SparkSession, path: str) -> Tables:
    """Hebrew tokens; the code is the braced root, cut at an underscore."""
    root = F.substring_index(F.coalesce(F.nullif(F.regexp_extract("strong", "\\{([^}]*)\\}", 1), F.lit("")), F.col("strong")), "_", 1)
    return _tagged(spark, path, "STEPBible-TAHOT", "hb", root, ["hebrew", "transliteration", "english", "strong", "morph"])


@adapter
def macula_greek(spark: SparkSession, path: str) -> Tables:
    """Header TSV of words with Louw-Nida domains: words, lemmas and IN_DOMAIN edges."""
    r = lines.tsv(spark, path, ["xml_id", "ref", "text", "lemma", "strong", "morph", "gloss", "domain", "ln"])
    code = strongs.canonical(F.col("strong"), F.lit("gk"))["canonical"]
    w = r.select(F.concat(F.lit("macula:"), "xml_id").alias("id"), "ref", text.nfc("text").alias("text"), text.nfc("lemma").alias("lemma"), code.alias("strong"), "morph", text.null_if_blank(F.col("gloss"), "n/a", "?").alias("gloss"), "ln", "file", "line_no")
    w = ordered.first_wins(w, ["id"], ["file", "line_no"])
    d = w.select("id", F.explode(F.filter(F.split(F.coalesce("ln", F.lit("")), "\\s+"), lambda x: x != "")).alias("code"))
    part = lambda k: F.regexp_extract("code", "^(\\d+)[.:](\\d+)", k).try_cast("int")
    d = d.withColumns({"domain": part(1), "sub": part(2)}).where("domain IS NOT NULL")
    lem = w.where("strong IS NOT NULL").groupBy("strong").agg(F.min("lemma").alias("lemma")).withColumn("id", F.concat(F.lit("gk:"), "strong"))
    return {"Word": w.drop("file", "line_no", "ln"), "GreekLemma": lem, "INSTANCE_OF": edges(w, F.col("id"), F.concat(F.lit("gk:"), "strong"), "INSTANCE_OF"), "IN_DOMAIN": edges(d, F.col("id"), F.concat(F.lit("ln:"), F.col("domain").cast("string")), "IN_DOMAIN", domain_code=F.col("domain"), subdomain_code=F.col("sub"))}


@adapter
def macula_hebrew(spark: SparkSession, path: str) -> Tables:
    """Streamed ``w`` elements: tokens, lemmas, and bridges from Hebrew to Greek lexemes (the first attributes win)."""
    r = markup.xml_rows(spark, path, "w", "_ref string, _lemma string, _morph string, _gloss string, _strongnumberx string, _greek string, _greekstrong string, _id string, _VALUE string")
    hb, gk = strongs.canonical(F.col("_strongnumberx"), F.lit("hb"))["canonical"], strongs.canonical(F.col("_greekstrong"), F.lit("gk"))["canonical"]
    t = r.select(F.concat(F.lit("macula:"), F.col("_id")).alias("id"), F.col("_ref").alias("ref"), text.nfc("_lemma").alias("lemma"), F.col("_morph").alias("morph"), text.null_if_blank(F.col("_gloss"), "n/a", "?").alias("gloss"), hb.alias("strong"), gk.alias("greek_strong"), F.col("_greek").alias("greek"), F.col("_VALUE").alias("surface"))
    lem = t.where("strong IS NOT NULL").groupBy("strong").agg(F.min("lemma").alias("lemma")).withColumn("id", F.concat(F.lit("hb:"), "strong"))
    pair = t.where("strong IS NOT NULL AND greek_strong IS NOT NULL").groupBy("strong", "greek_strong").agg(F.min_by("greek", "id").alias("greek"))
    return {"MaculaToken": t, "Lemma": lem, "INSTANCE_OF": edges(t, F.col("id"), F.concat(F.lit("hb:"), "strong"), "INSTANCE_OF"), "BRIDGES_LXX": edges(pair, F.concat(F.lit("hb:"), "strong"), F.concat(F.lit("gk:"), "greek_strong"), "BRIDGES_LXX", greek=F.col("greek"))}


@adapter
def oshb(spark: SparkSession, path: str) -> Tables:
    """OSIS books, one a task: verses, words with written and read forms, morphemes."""
    w = markup.parsed(spark.read.format("binaryFile").load(path).select("content"), "content", markup.osis_rows, markup.WORD)
    code = F.regexp_extract("lemma", "(\\d+\\s?[a-z]?)", 1)
    word = w.select(F.concat(F.lit("oshb:"), "id").alias("id"), F.col("verse").alias("osis"), "pos", F.regexp_replace("surface", "/", "").alias("surface"), strongs.canonical(code, F.lit("hb"))["canonical"].alias("strong"), "morph", "kind")
    parts = w.select(F.concat(F.lit("oshb:"), "id").alias("word_id"), F.posexplode(F.split("surface", "/")).alias("at", "form"))
    m = parts.select(F.concat_ws(".", "word_id", F.col("at").cast("string")).alias("id"), "word_id", "at", "form")
    verses = ordered.joined_text(word.where("kind <> 'ketiv'"), ["osis"], "pos", "surface").select(verse_id(F.col("osis")).alias("id"), "osis", "text", F.lit("OT").alias("canon_section"))
    qere = word.alias("q").join(word.where("kind = 'ketiv'").alias("k"), (F.col("q.osis") == F.col("k.osis")) & (F.col("q.pos") == F.col("k.pos")) & (F.col("q.kind") == "qere"))
    return {"Verse": verses, "Word": word, "Morpheme": m, "IN_VERSE": edges(word, F.col("id"), verse_id(F.col("osis")), "IN_VERSE"), "HAS_MORPHEME": edges(m, F.col("word_id"), F.col("id"), "HAS_MORPHEME"), "IS_QERE_OF": edges(qere, F.col("q.id"), F.col("k.id"), "IS_QERE_OF"), "INSTANCE_OF": edges(word, F.col("id"), F.concat(F.lit("hb:"), "strong"), "INSTANCE_OF")}


@adapter
def vulgate_clementine(spark: SparkSession, path: str) -> Tables:
    r = markup.xml_rows(spark, path, "verse", "_osis string, _canon string, _VALUE string").withColumn("b", text.without_brackets("_VALUE"))
    n = r.groupBy(F.col("_osis").alias("osis")).agg(F.first("_canon").alias("canon"), F.min("b.text").alias("text_latin"), F.first("b.notes").alias("transcription_notes"))
    return {"VulgateVerse": n}


@adapter
def theographic(spark: SparkSession, path: str) -> Tables:
    """JSON arrays of entities with verses: nodes by label, MENTIONS edges to verses."""
    r = spark.read.schema("id string, fields struct<entity_type:string,name:string,verses:array<string>,year:string>").option("multiLine", True).json(path)
    n = r.where("id IS NOT NULL").select(F.col("id").alias("entity_id"), F.col("fields.entity_type").alias("label"), F.col("fields.name").alias("display_name"), F.col("fields.year").try_cast("double").cast("int").alias("year"), F.coalesce("fields.verses", F.array().cast("array<string>")).alias("verses"))
    m = n.select("entity_id", F.explode(F.array_distinct("verses")).alias("v"))
    century = n.where("year IS NOT NULL").withColumn("century", F.floor(F.col("year") / 100)).groupBy("century").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("verses")))).alias("verses"))
    return {"Entity": n, "Period": century, "MENTIONS": edges(m, F.col("entity_id"), verse_id(F.col("v")), "MENTIONS")}


@adapter
def bhsa(spark: SparkSession, path: str) -> Tables:
    """A Text-Fabric folder: typed nodes, and which phrase or verse owns each slot (the last writer wins)."""
    def body(name: str) -> DataFrame:
        r = lines.lines(spark, f"{path}/{name}.tf")
        return lines.after_header(r, F.trim("line") == "").where(~F.col("line").startswith("@"))

    types = textfabric.type_ranges(body("otype"))
    nodes = types.select("otype", F.explode(F.sequence("lo", "hi")).alias("node_id"))
    slots = textfabric.node_feature(body("oslots")).select(F.col("node").alias("node_id"), textfabric.slots(F.col("value")).alias("slots"))
    owned = nodes.join(slots, "node_id")
    phrase = textfabric.slot_owners(owned.where("otype = 'phrase'").select(F.col("node_id").alias("node"), "slots"))
    ident = lambda c: F.concat(F.lit("bhsa:tf:"), F.col(c).cast("string"))
    return {"TFNode": nodes.select(ident("node_id").alias("id"), "otype", "node_id"), "CONTAINS_WORD": edges(phrase, ident("node"), ident("slot"), "CONTAINS_WORD")}


# --- chunks ----------------------------------------------------------------------------------------------------------

#: Work, anchor form, tradition, licence, and how many chunks it should give.
WORKS = {
    "wcf": ("WCF.{chapter}.{:d}", "reformed", "public_domain", 160, 200),
    "wlc_catechism": ("WLC.Q{:03d}", "reformed", "public_domain", 190, 200),
    "wsc": ("WSC.Q{:03d}", "reformed", "public_domain", 100, 115),
    "heidelberg": ("HC.Q{:03d}", "reformed", "public_domain", 125, 135),
    "belgic": ("Belgic.A{:02d}", "reformed", "public_domain", 37, 37),
    "dort": ("Dort.{chapter}.A{:02d}", "reformed", "public_domain", 50, 100),
    "lbc_1689": ("1689.{chapter}.{:d}", "reformed", "public_domain", 140, 160),
    "augsburg": ("Augsburg.A{:02d}", "lutheran", "public_domain", 25, 30),
    "articles_39": ("39A.A{:02d}", "anglican", "public_domain", 39, 39),
    "bcp_1662": ("BCP.Catechism.Q{:02d}", "anglican", "public_domain", 10, 200),
    "umc": ("UMC.A{:02d}", "methodist", "public_domain", 24, 26),
    "schleitheim": ("Schleitheim.A{:d}", "anabaptist", "public_domain", 7, 7),
    "ag": ("AG.A{:02d}", "pentecostal", "proprietary", 16, 16),
    "vatican_ccc": ("CCC.{:d}", "catholic-magisterial", "proprietary", 2400, 2870),
    "vatican_dv": ("DV.{:d}", "catholic-magisterial", "proprietary", 24, 28),
}
#: Works of questions and answers; their text is both.
CATECHISMS = {"wlc_catechism", "wsc", "heidelberg", "bcp_1662"}


def work_chunks(pages: DataFrame, work: str) -> DataFrame:
    """Chunks of a confessional work from its pages (url, html): its numbered parts, the first of equal numbers.

    A page's chapter, where the work has chapters and the page names none, is the number in its address.
    """
    form, tradition, licence, _, _ = WORKS[work]
    found = works.catechism("html") if work == "bcp_1662" else works.parts(work)("html")
    s = pages.select("url", F.posexplode(found).alias("at", "s")).select("url", "at", "s.*")
    s = s.withColumn("chapter", F.coalesce("chapter", F.regexp_extract("url", "(\\d+)\\D*$", 1).try_cast("int"))) if "{chapter}" in form else s.withColumn("chapter", F.lit(None).cast("int"))
    s = ordered.first_wins(s.withColumn("part", F.struct("chapter", "number")), ["part"], ["url", "at"])
    head, _, spec = form.partition("{:")
    width = int(spec.rstrip("d}") or 1)
    before, _, after = head.partition("{chapter}")
    head = F.concat(F.lit(before), F.col("chapter").cast("string"), F.lit(after)) if "{chapter}" in form else F.lit(head)
    anchor = F.concat(head, ordered.padded(F.col("number"), width))
    said = F.col("text")
    if work in CATECHISMS:
        n = F.when(F.lit(work != "bcp_1662"), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("")
        said = F.concat(F.lit("Q. "), n, F.regexp_replace("text", "^Q[. ]+", "")) if work == "heidelberg" else F.concat(F.lit("Q. "), n, "title", F.lit(" A. "), "text")
    embed = said if work in CATECHISMS else F.concat_ws(". ", F.nullif(F.col("title"), F.lit("")), said)
    return s.select(
        F.concat(F.lit(f"{work}."), anchor).alias("chunk_id"), F.lit(tradition).alias("tradition"), F.lit(work).alias("work_id"), anchor.alias("anchor_id"), "title", said.alias("text"), embed.alias("text_to_embed"),
        F.lit(licence).alias("license"), F.lit(licence == "public_domain").alias("redistribute"),
    )


def prayer_book(pages: DataFrame) -> DataFrame:
    """The whole prayer book from its pages (slug, title, url, html): the catechism by questions, every other section as one chunk with
    its page's heading, or ``title`` where that has none. Pages without text give nothing."""
    asked = work_chunks(pages.where("slug = 'catechism'").select("url", "html"), "bcp_1662")
    s = pages.where("slug <> 'catechism'").select("slug", F.col("title").alias("named"), works.prose_section("html").alias("s")).where("s.text <> ''")
    anchor, title, free = F.concat(F.lit("BCP."), "slug"), F.coalesce(F.nullif(F.trim("s.title"), F.lit("")), "named"), WORKS["bcp_1662"][2]
    prose = s.select(
        F.concat(F.lit("bcp_1662."), anchor).alias("chunk_id"), F.lit(WORKS["bcp_1662"][1]).alias("tradition"), F.lit("bcp_1662").alias("work_id"), anchor.alias("anchor_id"), title.alias("title"), F.col("s.text").alias("text"),
        F.concat_ws(". ", title, "s.text").alias("text_to_embed"), F.lit(free).alias("license"), F.lit(free == "public_domain").alias("redistribute"),
    )
    return asked.unionByName(prose)


def in_band(n: int, work: str) -> bool:
    return WORKS[work][3] <= n <= WORKS[work][4]


def volume_chunks(paragraphs: DataFrame, anchor: str, target: int = 533, least: int = 133) -> DataFrame:
    """Chunks packed from (work_id, chapter, at, text): one row a chunk, anchors numbered within the chapter."""
    p = paragraphs.groupBy("work_id", "chapter").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("p"))
    p = p.select("work_id", "chapter", "p", F.posexplode(ordered.packed(F.transform("p", lambda x: text.word_count(x["text"])), target, least)).alias("k", "c"))
    body = F.array_join(F.filter(F.transform(F.slice("p", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), lambda x: x["text"]), lambda t: F.trim(t) != ""), "\n\n")
    return p.select("work_id", "chapter", F.concat_ws(".", F.lit(anchor), "chapter", ordered.padded(F.col("k") + 1, 3)).alias("anchor_id"), body.alias("text"), F.col("c.words").alias("words"))


@adapter
def brethren_parsed(spark: SparkSession, path: str) -> Tables:
    """Parsed JSON documents; ids come from the slug and the place, files that can't be read are skipped."""
    d = markup.json_docs(spark, path, "doc_slug string, source_mtime string, session_metadata struct<title:string>, chunks array<struct<chunk_id:string,type:string,content:string>>")
    d = d.where("doc_slug IS NOT NULL AND _corrupt_record IS NULL").where(~F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).startswith("_"))
    c = d.select("doc_slug", F.coalesce("session_metadata.title", "doc_slug").alias("work_title"), F.substring("source_mtime", 1, 4).alias("date_written"), F.posexplode("chunks").alias("at", "c")).where(F.trim("c.content") != "")
    anchor = F.concat(F.lit("parsed."), "doc_slug", F.lit("."), ordered.padded(F.col("at") + 1, 3))
    return {"CulturalChunk": c.select(F.concat(F.lit("brethren-parsed."), anchor).alias("chunk_id"), F.lit("plymouth-brethren").alias("tradition"), F.concat(F.lit("brethren-parsed."), "doc_slug").alias("work_id"), "work_title", "date_written", anchor.alias("anchor_id"), F.trim("c.content").alias("text"), F.lit("parsed-sanitized").alias("license"), F.lit(False).alias("redistribute"))}


@adapter
def sefaria_mishnah(spark: SparkSession, path: str) -> Tables:
    """Ragged JSON: chapters of pieces, counted from 1; blank pieces keep their number and give no chunk."""
    d = markup.json_docs(spark, path, "title string, text array<array<string>>").where("text IS NOT NULL")
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "^mishnah\\s+", ""), "[^a-z0-9]+", "_")
    r = d.select(F.explode(markup.ragged(slug, F.col("text"))).alias("r")).select("r.*").withColumn("clean", text.collapse_space(F.regexp_replace("text", "<[^>]+>", ""))).where("clean <> ''")
    anchor = F.concat_ws(".", F.lit("mishnah"), "doc_id", F.col("chapter").cast("string"), F.col("n").cast("string"))
    return {"HistoricalChunk": r.select(anchor.alias("chunk_id"), anchor.alias("anchor_id"), F.concat(F.lit("mishnah."), "doc_id").alias("work_id"), F.col("clean").alias("text"), F.lit("cc0").alias("license"), F.lit(True).alias("redistribute"))}


@adapter
def tei_history(spark: SparkSession, path: str) -> Tables:
    """TEI editions: a chunk for each innermost numbered division, by its path of numbers."""
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)\\.xml$", 1).alias("work_id"), "content")
    s = markup.parsed(raw, "content", markup.tei_rows, markup.TEI_SECTION).where("text <> ''")
    anchor = F.concat_ws(".", "work_id", "path")
    return {"HistoricalChunk": s.select(anchor.alias("chunk_id"), anchor.alias("anchor_id"), "work_id", "text", F.lit("public_domain").alias("license"), F.lit(True).alias("redistribute"))}


#: The works of the historian, by short name: label in citations, and whether it has books.
JOSEPHUS = {"ant": ("Ant", True), "wars": ("Wars", True), "apion": ("Apion", True), "vita": ("Vita", False)}


@adapter
def josephus(spark: SparkSession, path: str, work: str = "ant", contested: dict[str, tuple[str, str]] | None = None) -> Tables:
    """One work's TEI: a chunk for each section, cited by the older chapters and sections, which milestones carry forward.

    ``contested``: anchor -> (note, pattern of the disputed clause); it is left out of what is embedded. A clause that
    isn't there puts its chunk into quarantine.
    """
    label, books = JOSEPHUS[work]
    s = markup.parsed(spark.read.format("binaryFile").load(path).select("path", "content"), "content", markup.milestone_rows, markup.MILESTONE_SECTION)
    s = ordered.carry(s.withColumn("book", F.coalesce("book", F.lit("1"))), ["path", "book"], ["at"], "chapter", "of")
    tail = F.filter(F.array(F.regexp_replace("of", "\\.+$", ""), F.col("part")), lambda x: x.isNotNull() & (x != ""))
    cited = F.concat(F.array(F.col("book")), tail) if books else tail
    citation = F.when(F.size(tail) > 0, F.concat(F.lit(f"{label} "), F.array_join(cited, "."), F.lit(" (Whiston)")))
    c = s.where("text <> ''").select(F.concat_ws(".", F.lit(f"josephus.{work}"), "book", "section").alias("anchor_id"), citation.alias("anchor_alt_citation"), "text")
    note, embed, ok = F.lit(None).cast("string"), F.col("text"), F.lit(True)
    for anchor, (why, pattern) in (contested or {}).items():
        here = F.col("anchor_id") == anchor
        span = text.without_span(F.col("text"), pattern)
        note, embed, ok = F.when(here, why).otherwise(note), F.when(here, span["text_to_embed"]).otherwise(embed), F.when(here, span["ok"]).otherwise(ok)
    c = c.select(F.col("anchor_id").alias("chunk_id"), "anchor_id", "anchor_alt_citation", F.lit(f"josephus.{work}").alias("work_id"), "text", embed.alias("text_to_embed"), note.alias("note"), note.isNotNull().alias("redact_for_embedding"), F.lit("CC-BY-SA-4.0").alias("license"), F.lit(True).alias("redistribute"), ok.alias("__ok"))
    return {"HistoricalChunk": c.where("__ok").drop("__ok"), "quarantine": c.where("NOT __ok").select("chunk_id")}


def confession(work: str) -> Callable[[SparkSession, str], Tables]:
    """The adapter of a confessional work: its saved pages, one file each."""

    def read(spark: SparkSession, path: str) -> Tables:
        pages = spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), markup.decoded("content").alias("html"))
        return {"CulturalChunk": work_chunks(pages, work)}

    read.__name__ = work
    read.__doc__ = f"Chunks of {work} from its saved pages."
    return read


for _work in WORKS:
    adapter(confession(_work))


def volume_pages(pages: DataFrame, anchor: str) -> DataFrame:
    """Packed chunks of a volume's pages (work_id, chapter, html)."""
    p = pages.select("work_id", "chapter", F.posexplode(works.volume_paragraphs("html")).alias("at", "text"))
    return volume_chunks(p, anchor)


def stem_publishing(pages: DataFrame) -> DataFrame:
    """Chunks of works at ``.../authors/<author>/<work>.html`` (url, html); index pages are no works."""
    part = lambda k: F.regexp_extract("url", "/authors/([^/]+)/([^/]+)\\.html$", k)
    named = pages.where((part(2) != "") & ~F.contains(F.lower(part(2)), F.lit("index"))).select(F.concat_ws(".", F.lit("stem-publishing"), part(1), part(2)).alias("work_id"), F.concat_ws(".", part(1), part(2)).alias("chapter"), "html")
    c = volume_pages(named, "STEM")
    return c.select(F.concat(F.lit("stem-publishing."), "anchor_id").alias("chunk_id"), F.lit("plymouth-brethren").alias("tradition"), "work_id", "anchor_id", "text", F.lit("public_domain").alias("license"), F.lit(True).alias("redistribute"))


def oca_hopko(pages: DataFrame, root: str, least: int = 100) -> DataFrame:
    """Chunks of article pages below ``root`` (url, html); pages with less text than ``least`` characters are none."""
    a = pages.where(F.col("url").startswith(root)).withColumn("a", works.article("html")).where(F.length("a.text") >= least)
    anchor = F.concat(F.lit("OCA."), F.translate(F.substring("url", len(root.rstrip("/")) + 2, 10_000_000), "/", "."))
    return a.select(F.concat(F.lit("oca-hopko."), anchor).alias("chunk_id"), F.lit("eastern-orthodox").alias("tradition"), F.lit("oca-hopko").alias("work_id"), anchor.alias("anchor_id"), F.col("a.title").alias("title"), F.col("a.text").alias("text"), F.concat_ws(". ", "a.title", "a.text").alias("text_to_embed"), F.lit("proprietary").alias("license"), F.lit(False).alias("redistribute"))


def to_store(chunks: DataFrame) -> Tables:
    """Works, chunks and HAS_CHUNK edges; text that may not be shared in bulk is replaced by what is embedded."""
    from quillgraph.functions import licence

    ok = licence.guard(F.col("license"), "bulk")["allowed"]
    embed = F.col("text_to_embed") if "text_to_embed" in chunks.columns else F.col("text")
    kept = chunks.withColumn("text", F.when(ok, F.col("text")).otherwise(embed))
    works = chunks.groupBy("work_id").agg(F.max_by("license", "chunk_id").alias("license"))
    return {"Work": works, "Chunk": kept, "HAS_CHUNK": edges(chunks, F.col("work_id"), F.col("chunk_id"), "HAS_CHUNK")}
