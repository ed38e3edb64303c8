"""The query surface and the adapters on hand-made tables and files."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.plans import adapters, surface


@pytest.fixture(scope="module")
def lex(spark):
    verses = spark.createDataFrame([("verse:Gen.1.1", "Gen.1.1", "aleph bet gimel dalet", "OT"), ("verse:John.1.1", "John.1.1", "en arche en ho logos", "NT")], "id string, osis string, text string, canon_section string")
    lemmas = spark.createDataFrame([("l1", "H0430", "elohim"), ("l2", "G3056", "logos"), ("l3", "G3056", "logoS")], "id string, strong string, lemma string")
    entries = spark.createDataFrame([("H0430", "H0430", None, "elohim", "elo", "God"), ("G3056", "G3056", "logos", None, "logos", "word"), ("G3056", "G3056a", "x", None, "x", "x")], "base_strong string, strong_disambig string, greek string, hebrew string, transliteration string, english string")
    words = spark.createDataFrame([(f"w{k}", "OSHB", "H0430", "elohim", s, "m", "verse:Gen.1.1") for k, s in enumerate(["bet", "gimel"])], "id string, source string, strong string, lemma string, surface string, morph string, verse_id string")
    tokens = spark.createDataFrame([("t1", "TAGNT", "G3056", "logos", "n", "verse:John.1.1"), ("t2", "TAHOT", "H0430", "bet", "n", "verse:Gen.1.1"), ("t3", "TAHOT", "H0430", "bet", "n", "verse:Gen.1.1")], "id string, source string, strong string, surface string, morph string, verse_id string")
    edges = spark.createDataFrame([("verse:Gen.1.1", "verse:John.1.1", "OPENBIBLE_CROSS_REF", 7)], "src_id string, dst_id string, rel_type string, votes int")
    crossrefs = spark.createDataFrame([("Gen.1.1", "Ps.8.3", None), ("Gen.1.1", "Heb.11.3", 9)], "from_ref string, to_ref string, votes int")
    return surface.Lexical(verses, lemmas, entries, words, tokens, edges, crossrefs)


def test_lookup(lex):
    r = surface.lexical_lookup(lex, "H0430", "strong").first()
    assert (r["lemma"], r["gloss"], r["occurrences_in_canon"], r["truncated"]) == ("elohim", "God", 4, False) and r["audit"]["response_safe_to_share"]
    assert surface.lexical_lookup(lex, "H0430", "strong", fixed=False).first()["occurrences_in_canon"] == 2  # equal counts count once
    for kind, q, want in (("lemma", "logos", "G3056"), ("surface", "bet", "H0430"), ("gloss", "wor", "G3056")):
        assert [x["strong"] for x in surface.lexical_lookup(lex, q, kind).collect()] == [want]
    assert surface.lexical_lookup(lex, "G3056", "strong", limit=1).first()["truncated"]
    for bad in ({"limit": 0}, {"limit": 201}):
        with pytest.raises(ValueError):
            surface.lexical_lookup(lex, "x", "strong", **bad)
    with pytest.raises(ValueError):
        surface.lexical_lookup(lex, "x", "nothing")


def test_concordance(lex):
    rows = surface.concordance_walk(lex, "H0430", window=1).collect()
    assert sorted(r["tok"] for r in rows) == ["t2", "t3", "w0", "w1"] and {r["ref"] for r in rows} == {"Gen.1.1"}
    assert {(r["context_left"], r["context_right"]) for r in rows if r["tok"] == "w0"} == {("aleph", "gimel")}
    assert surface.concordance_walk(lex, "H0430", filter_book=["John"]).count() == 0


def test_cross_refs(spark, lex):
    got = surface.cross_ref(lex, spark.createDataFrame([("Gen.1.1",)], "ref string")).orderBy("rank").collect()
    assert [(r["to_ref"], r["source"], r["votes"]) for r in got] == [("Heb.11.3", "tsk", 9), ("John.1.1", "openbible", 7), ("Ps.8.3", "tsk", 1)]
    assert surface.cross_ref(lex, spark.createDataFrame([("Gen.1.1",)], "ref string"), min_votes=8, from_sources=["tsk"]).count() == 1


def test_small_tools(spark, lex):
    refs = spark.createDataFrame([("Gen.1.1",), ("No.1.1",)], "ref string")
    assert surface.variant_inspect(refs).where("ecm_published").count() == 0
    assert {(r["ref"], r["translation"], r["lang"]) for r in surface.parallel_translation(lex, refs, ["ESV"]).collect()} == {("Gen.1.1", "original", "hb"), ("Gen.1.1", "ESV", None), ("No.1.1", "ESV", None)}
    rules = spark.createDataFrame([(2, "eng", "A.1.1", "heb", "A.1.3", "r", "b"), (1, "eng", "A.1.1", "heb", "A.1.2", "r", "b")], "line_no int, from_scheme string, from_ref string, to_scheme string, to_ref string, rule_type string, block_scope string")
    q = spark.createDataFrame([("A.1.1", "eng", "heb"), ("B.1.1", "eng", "heb")], "ref string, from_scheme string, to_scheme string")
    assert {(r["ref"], r["to_ref"], r["rule_type"], r["inverse"]["from_ref"]) for r in surface.versification_resolve(q, rules).collect()} == {("A.1.1", "A.1.2", "r", "A.1.2"), ("B.1.1", "B.1.1", "identity", "B.1.1")}
    a = spark.createDataFrame([("r1", [("s", "pd"), ("t", "© x")]), ("r2", [])], "request_id string, sources array<struct<source:string,license:string>>")
    assert {(r["request_id"], r["redistributable"]) for r in surface.license_audit(a).collect()} == {("r1", False), ("r2", False)}


@pytest.fixture(scope="module")
def cultural(spark):
    rows = [(f"c{k}", t, "w", f"Work {t}", [k * 1.0, 1.0], [("grace", s, 0.9), ("law", "denies", 0.95)], "word " * 150, lic, free, 20_000) for k, (t, s, lic, free) in enumerate([("reformed", "affirms", "pd", True), ("lutheran", "denies", "© 1", False), ("reformed", None, "pd", True)])]
    return spark.createDataFrame(rows, "chunk_id string, tradition string, work_id string, work_title string, vector array<double>, doctrine_tags array<struct<doctrine:string,stance:string,confidence:double>>, text string, license string, redistribute boolean, source_work_word_count int")


def test_overlay_and_verdict(spark, cultural):
    q = spark.createDataFrame([("q1", [0.0, 1.0], "grace", ["grace", "law"])], "query_id string, vector array<double>, doctrine string, doctrines array<string>")
    hits = surface.retrieve_chunks(q, cultural, 3)
    assert [(r["chunk_id"], r["stance"]) for r in hits.orderBy("rank").collect()] == [("c0", "affirms"), ("c1", "denies"), ("c2", None)]
    assert surface.retrieve_chunks(q, cultural, 3, ["lutheran"]).count() == 1
    o = surface.cultural_overlay(hits).first()
    assert set(o["by_tradition"]) == {"reformed", "lutheran"} and len(o["passages"][1]["snippet"].split()) == 100 and o["passages"][1]["paraphrase"].endswith(" ...")
    assert surface.debate_for_verse(q, cultural).count() == 1
    questions = spark.createDataFrame([("doc-grace", "Is grace a free gift?"), ("doc-law", "Does the law save anyone?")], "question_id string, statement string")
    ask = spark.createDataFrame([("q1", "grace is a free gift"), ("q2", "zzz qqq")], "query_id string, proposition string")
    evidence = spark.createDataFrame([("doc-grace", "true", "broad", "because", [("s", "pd")])], "question_id string, affirms string, breadth string, summary string, sources array<struct<source:string,license:string>>")
    history = spark.createDataFrame([("doc-grace", [("a", 0.1), ("b", 0.9), ("c", 0.5)])], "question_id string, witnesses array<struct<witness_id:string,confidence:double>>")
    got = {r["query_id"]: r for r in surface.doctrinal_verdict(ask, questions, evidence, surface.cultural_overlay(hits), history).collect()}
    assert (got["q1"]["verdict"], got["q1"]["confidence"], got["q1"]["top_witnesses"], got["q1"]["error"]) == ("true", "high", ["b", "c"], None)
    assert [(c["stance"], c["n"]) for c in got["q1"]["cultural"]] == [("affirms", 1), ("denies", 1), ("unstated", 1)]
    assert got["q2"]["error"] == "no_matching_question" and got["q2"]["confidence"] == "none"


def test_inspect(spark):
    docs = spark.createDataFrame([("doc-a", '{"x": 1}'), ("doc-b", "{oops")], "question_id string, json string")
    ask = spark.createDataFrame([("doc-a",), ("doc-b",), ("doc-c",), ("../etc",)], "question_id string")
    got = {r["question_id"]: (r["error"], r["doc"] and r["doc"]["x"]) for r in surface.inspect(ask, docs, "x int").collect()}
    assert got == {"doc-a": (None, 1), "doc-b": ("corrupt", None), "doc-c": ("missing", None), "../etc": ("invalid_question_id", None)}


def test_bundles(spark, lex, cultural):
    q = spark.createDataFrame([("q1", ["Genesis 1:1", "Nowhere 1:1"])], "question_id string, scripture_anchors array<string>")
    b = surface.lexical_bundle(lex, q)
    assert b.where("part = 'lemma'").first()["value"] == "4/4" and b.where("part = 'xref'").count() == 2 and b.where("part = 'word'").count() == 2
    qv = spark.createDataFrame([("q1", [0.0, 1.0])], "query_id string, vector array<double>")
    terms = spark.createDataFrame([("q1", "WORD")], "query_id string, term string")
    h = surface.historical_bundle(qv, cultural.select("chunk_id", F.col("tradition").alias("source_type"), "text", "vector"), ["lutheran", "reformed"], terms, each=1, most=10)
    assert [(r["id"], r["leg"]) for r in h.orderBy("rank").collect()] == [("c1", 0), ("c0", 0), ("c2", 1)]


def test_adapters_from_text(spark, tmp_path):
    def put(name, body, encoding="utf-8"):
        (tmp_path / name).write_bytes(body.encode(encoding))
        return str(tmp_path / name)

    t = adapters.morphgnt(spark, put("61-Mt-morphgnt.txt", "010101 N- ----NSF- Βίβλος Βίβλος βίβλος βίβλος\n010101 N- ----GSF- γενέσεως γενέσεως γενέσεως γένεσις\nbad line\n"))
    assert [r["id"] for r in t["Word"].orderBy("id").collect()] == ["morphgnt:Matt.1.1.01", "morphgnt:Matt.1.1.02"]
    assert t["Verse"].first()["text"] == "Βίβλος γενέσεως" and t["IN_VERSE"].count() == 2
    head = "Some prose\neStrong\tdStrong\tuStrong\tGreek\tTr\tMorph\tGloss\tMeaning\n"
    t = adapters.stepbible_tbesg(spark, put("g.txt", head + "G0001\tG0001\t1\tΑ\talpha\tN\tAlpha\tx\nG0001\tG0001\t1\tB\tb\tN\tb\tb\nG0002\tG0002\tG2\t\taaron\tN\t\ty\n"))
    assert {(r["strong_disambig"], r["base_strong"], r["greek"], r["english"]) for r in t["BriefLexEntry"].collect()} == {("G0001", "G0001", "Α", "Alpha"), ("G0002", "G0002", "aaron", None)}
    t = adapters.stepbible_tvtms(spark, put("v.txt", "# c\nenglish\tA.1.1\thebrew\tA.1.2\tr\tn\nenglish\tA.1.1\thebrew\tA.1.2\tr\tn\n"))
    assert sorted(r["id"] for r in t["VersificationRule"].collect()) == ["tvtms:english:A.1.1:hebrew:A.1.2:r", "tvtms:english:A.1.1:hebrew:A.1.2:r#1"]
    rules = adapters.english_rules(t["VersificationRule"])
    t = adapters.openbible(spark, put("o.txt", "From\tTo\tVotes\nA.1.1\tB.1.1-B.1.3\t5\nbad\tB.1.1\t2\nA.1.1\tB.1.1\tx\n"), rules)
    assert [(r["src_id"], r["dst_id"], r["votes"]) for r in t["OPENBIBLE_CROSS_REF"].collect()] == [("verse:A.1.2", "verse:B.1.1", 5)] and t["quarantine"].count() == 1
    t = adapters.tsk(spark, put("t.txt", "1\t1\t1\t1\tbegin\xe9\tJohn.1.1-2;Heb.1.10\nx\t1\t1\t1\tk\tGen.1.1\n", "latin-1"))
    assert {r["to_ref"] for r in t["CrossRef"].collect()} == {"John.1.1", "John.1.2", "Heb.1.10"} and t["CrossRef"].first()["keyword"] == "beginé"
    t = adapters.stepbible_tahot(spark, put("h.txt", "intro\nGen.1.1#01=L\tx\ty\tz\tH9003/{H7225G}\tm\nGen.1.1#01=L\tx\ty\tz\tH1\tm\n"))
    assert [(r["id"], r["strong"]) for r in t["TaggedToken"].collect()] == [("STEPBible-TAHOT:Gen.1.1#01", "H7225G")]
    t = adapters.stepbible_morph_codes(spark, put("m.txt", "x\n$ HVqp3ms\nVerb OR Other\n$ N\nNoun\n"))
    assert {r["code"]: r["expansions"] for r in t["MorphCode"].collect()} == {"HVqp3ms": ["Verb", "Other"], "N": ["Noun"]}
    t = adapters.peshitta(spark, put("p.tsv", "verse_ref\ttoken_pos\ttext\tlex\tgloss\tmorph\nMatt.1.1\t1\ta\tb\t\tm\nMatt.1.1\t\tc\td\tg\tm\n"))
    assert {r["id"] for r in t["SyriacWord"].collect()} == {"peshitta:Matt.1.1:1", "peshitta:Matt.1.1:2"}
    t = adapters.macula_greek(spark, put("mg.tsv", "id\tref\ttext\tlemma\tstrong\tmorph\tgloss\tdomain\tln\nn1\tr\tλόγος\tλόγος\t3056\tN\tword\td\t33.98a 33:9\n"))
    assert {(r["domain_code"], r["subdomain_code"]) for r in t["IN_DOMAIN"].collect()} == {(33, 98), (33, 9)} and t["GreekLemma"].first()["strong"] == "G3056"
    with pytest.raises(Exception):
        adapters.peshitta(spark, str(tmp_path / "missing.tsv"))["SyriacWord"].count()


def test_adapters_from_markup(spark, tmp_path):
    (tmp_path / "gen.xml").write_text("<osis><verse osisID='Gen.1.1'><w id='a' lemma='b/7225' morph='HR'>בְּ/רֵאשִׁית</w><w id='k' lemma='1' type='x-ketiv'>K</w><note><rdg><w id='q' lemma='2'>Q</w></rdg></note></verse></osis>")
    t = adapters.oshb(spark, str(tmp_path / "gen.xml"))
    assert t["Word"].count() == 3 and t["Morpheme"].count() == 4 and t["Word"].where("id = 'oshb:a'").first()["strong"] == "H7225"
    assert [(r["src_id"], r["dst_id"]) for r in t["IS_QERE_OF"].collect()] == [("oshb:q", "oshb:k")]
    assert t["Verse"].first()["text"].endswith(" Q")
    (tmp_path / "mac.xml").write_text("<x><w ref='GEN 1:1!1' id='1' lemma='a' morph='m' gloss='g' strongnumberx='7225' greek='arche' greekstrong='746'>S</w><w ref='r' id='2' lemma='a' strongnumberx='7225' greek='zzz' greekstrong='746'>S</w></x>")
    t = adapters.macula_hebrew(spark, str(tmp_path / "mac.xml"))
    assert t["MaculaToken"].count() == 2 and [(r["src_id"], r["dst_id"], r["greek"]) for r in t["BRIDGES_LXX"].collect()] == [("hb:H7225", "gk:G0746", "arche")]
    (tmp_path / "p.json").write_text(json.dumps({"doc_slug": "d", "source_mtime": "2024-01", "session_metadata": {"title": "T"}, "chunks": [{"content": " a "}, {"content": " "}, {"content": "b"}]}))
    got = adapters.brethren_parsed(spark, str(tmp_path / "p.json"))["CulturalChunk"].orderBy("chunk_id").collect()
    assert [(r["anchor_id"], r["text"]) for r in got] == [("parsed.d.001", "a"), ("parsed.d.003", "b")]
    (tmp_path / "m.json").write_text(json.dumps({"title": "Mishnah Avot", "text": [["a <b>b</b>", ""], [], ["c"]]}))
    assert {r["anchor_id"]: r["text"] for r in adapters.sefaria_mishnah(spark, str(tmp_path / "m.json"))["HistoricalChunk"].collect()} == {"mishnah.avot.1.1": "a b", "mishnah.avot.3.1": "c"}
    (tmp_path / "jos.xml").write_text("<TEI><div n='1'><div n='2'><p>x</p></div></div></TEI>")
    assert adapters.tei_history(spark, str(tmp_path / "jos.xml"))["HistoricalChunk"].first()["anchor_id"] == "jos.1.2"
    (tmp_path / "e.json").write_text(json.dumps([{"id": "p1", "fields": {"entity_type": "Person", "name": "N", "verses": ["Gen.1.1", "Gen.1.1"], "year": "-4000.5"}}]))
    t = adapters.theographic(spark, str(tmp_path / "e.json"))
    assert t["MENTIONS"].count() == 1 and t["Period"].first()["century"] == -40
    tf = tmp_path / "tf"
    tf.mkdir()
    (tf / "otype.tf").write_text("@node\n@x=y\n\n1-4\tword\n5-6\tphrase\n")
    (tf / "oslots.tf").write_text("@edge\n\n5\t1-2\n3-4\n")
    t = adapters.bhsa(spark, str(tf))
    assert {(r["src_id"], r["dst_id"]) for r in t["CONTAINS_WORD"].collect()} == {("bhsa:tf:5", "bhsa:tf:1"), ("bhsa:tf:5", "bhsa:tf:2"), ("bhsa:tf:6", "bhsa:tf:3"), ("bhsa:tf:6", "bhsa:tf:4")}


def test_chunks(spark):
    page = "<article><h2>Article 1. A</h2><p>one</p><h2>Article 2</h2><p>two</p><h2>Article 1 again</h2><p>no</p></article>"
    got = adapters.work_chunks(spark.createDataFrame([("u", page)], "url string, html string"), "belgic")
    assert {r["anchor_id"]: r["text"] for r in got.collect()} == {"Belgic.A01": "one", "Belgic.A02": "two"}
    assert adapters.in_band(37, "belgic") and not adapters.in_band(2, "belgic")
    p = spark.createDataFrame([("w", "c1", k, "x " * 300) for k in range(4)], "work_id string, chapter string, at int, text string")
    assert sorted((r["anchor_id"], r["words"]) for r in adapters.volume_chunks(p, "ANF.vol1").collect()) == [("ANF.vol1.c1.001", 300), ("ANF.vol1.c1.002", 300), ("ANF.vol1.c1.003", 300), ("ANF.vol1.c1.004", 300)]
    s = adapters.to_store(got.withColumn("text_to_embed", F.lit("e")))
    assert s["Work"].count() == 1 and s["HAS_CHUNK"].count() == 2 and s["Chunk"].where("text = 'e'").count() == 0
