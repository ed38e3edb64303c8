"""Further adapters and sinks on hand-made files."""

import sqlite3
import uuid

import pytest
from pyspark.sql import functions as F

from quillgraph.plans import more_adapters as A
from quillgraph.plans.adapters import ADAPTERS
from quillgraph.sources import sinks


def put(folder, name, body):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(body)
    return str(p)


def test_registry():
    assert len(ADAPTERS) >= 30 and all(callable(f) for f in ADAPTERS.values())


def test_features(spark, tmp_path):
    put(tmp_path, "phono.tf", "@node\n\n5\tba\nra\n\nx\n")
    assert {r["id"]: r["phono"] for r in A.etcbc_phono(spark, str(tmp_path))["phono"].collect()} == {"bhsa:tf:5": "ba", "bhsa:tf:6": "ra", "bhsa:tf:8": "x"}
    t = A.etcbc_parallels(spark, put(tmp_path, "c.tf", "1\t2\t85\n3\t90\n\n9\t4\tbad\n"))
    assert {(r["src_id"], r["dst_id"], r["similarity"]) for r in t["PARALLEL_OF"].collect()} == {("bhsa:tf:1", "bhsa:tf:2", 0.85), ("bhsa:tf:1", "bhsa:tf:3", 0.9)} and t["quarantine"].count() == 1


def test_tagged(spark, tmp_path):
    t = A.stepbible_ttesv(spark, put(tmp_path, "t.txt", "x\n$Gen 1:1\tbad\t1=<7225>\t2=<1>\n$John 1:1\t3+4=<3056>\n$John 1:2\tnone\n"))
    assert {(r["id"], r["strong"]) for r in t["TaggedToken"].collect()} == {("ttesv:Gen.1.1#01", "H7225"), ("ttesv:John.1.1#03", "G3056")}
    t = A.stepbible_proper_nouns(spark, put(tmp_path, "n.txt", "prose\n$=== PERSON\nhead\n– Named\tAaron\tH175=x\tExod.4.14; Exod.4.27\n– Other\tNo\tH1\t\n$=== PLACE\n– Named\tZion\tH6726\t\n"))
    assert {(r["proper_name_entry"], r["pos"], r["strong"], r["verse_count"]) for r in t["ProperNoun"].collect()} == {("Aaron", "PERSON", "H0175", 2), ("Zion", "PLACE", "H6726", None)}
    assert [r["dst_id"] for r in t["NAMED_AT"].collect()] == ["verse:Exod.4.14"]
    put(tmp_path, "cop/sahidic.x/doc1.tt", "# c\n<ab>\tl\tN\tMark.1.1\n\nzz\t\tV\n")
    put(tmp_path, "cop/other/doc2.tt", "a\tb\tc\n")
    got = A.coptic_scriptorium(spark, str(tmp_path / "cop"))["CopticWord"].orderBy("token_pos").collect()
    assert [(r["id"], r["norm"], r["supplement"], r["lemma"]) for r in got] == [("coptic-scriptorium:sahidic.x:doc1:0", "ab", True, "l"), ("coptic-scriptorium:sahidic.x:doc1:1", "zz", False, None)]


def test_collation(spark, tmp_path):
    x = put(tmp_path, "c.xml", "<t><app n='B25K1V3U2'><rdg n='a' wit='P9 01'>x</rdg><rdg n='b' wit='01C'>y</rdg></app><app n='B25K2V3U2'><rdg n='a' wit='P9'>x</rdg></app></t>")
    db = str(tmp_path / "w.db")
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE WITNESSES (WITNESS TEXT)")
        con.executemany("INSERT INTO WITNESSES VALUES (?)", [("P9",), ("01",), ("01C",), ("33",), ("33",)])
    t = A.open_cbgm_3_john(spark, x, db)
    assert {(r["src_id"], r["dst_id"]) for r in t["ATTESTED_BY"].collect()} == {("3John.1.3/2-a", "P9"), ("3John.1.3/2-a", "01"), ("3John.1.3/2-b", "01C"), ("3John.1.3/2-lac", "33")}
    assert [(r["src_id"], r["dst_id"]) for r in t["CORRECTOR_OF"].collect()] == [("01C", "01")]


def test_history(spark, tmp_path):
    got = {r["anchor_id"]: r["text"] for r in A.philo(spark, put(tmp_path, "p.html", "<p>intro (1) one (5) more ( 2) two</p>"))["HistoricalChunk"].collect()}
    assert got == {"philo.1": "one (5) more", "philo.2": "two"}
    got = A.pliny_melmoth(spark, put(tmp_path, "m.txt", "x\n### LETTER Ep 10.96\na\nb\n### LETTER Ep 9.1\nz\n"))["HistoricalChunk"].collect()
    assert [(r["chunk_id"], r["text"]) for r in got] == [("pliny.epistulae.10.96.en", "a b")]
    page = "<h2>Chapter 1</h2><p>lead 1. one 2. two 1. again</p><h2>Chapter 2</h2><p>alone</p>"
    got = {r["anchor_id"]: r["text"] for r in A.pseudepigrapha(spark, put(tmp_path, "e.html", page))["HistoricalChunk"].collect()}
    assert got == {"enoch.1.1": "lead one", "enoch.1.2": "two", "enoch.1.1b": "again", "enoch.2.1": "alone"}
    tei = '<TEI><body><p><milestone unit="chapter" n="1"/>a<note>q</note> b <milestone unit="chapter" n="2"/>c</p></body></TEI>'
    assert {r["anchor_id"]: r["text"] for r in A.roman_historians(spark, put(tmp_path, "t.xml", tei))["HistoricalChunk"].collect()} == {"tacitus.annals.1": "a b", "tacitus.annals.2": "c"}


def test_scrolls(spark, tmp_path):
    f = {"otype": "1-4\tslot\n5-6\tline\n7-9\tword\n", "oslots": "5\t1-2\n6\t3-4\n7\t1\n8\t2\n9\t3\n", "fulle": "7\tab\ncd\nef\n", "after": "7\t \n", "lang": "7-8\tHebrew\n9\tAramaic\n", "scroll": "5-6\t1QS\n", "fragment": "5\t3\nf1+2\n", "label": "5\t7\n12\n"}
    for name, body in f.items():
        put(tmp_path, f"{name}.tf", f"@node\n\n{body}")
    got = {r["anchor_id"]: (r["text"], r["language"]) for r in A.etcbc_dss(spark, str(tmp_path))["HistoricalChunk"].collect()}
    assert got == {"1qs.col03.line07": ("ab cd", "hbo"), "1qs.f1p2.line12": ("ef", "arc")}


def test_creeds(spark):
    p = spark.createDataFrame([("<p>Nicene may refer to many</p>",), ("<p>We believe " + "in one God " * 40 + "</p>",)], "html string")
    assert sorted(len(r["_violations"]) for r in A.creed(p, ["we believe"]).collect()) == [0, 3]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", False, "x"), ("a", False, None), ("c", None, "y"), ("d", True, " ")], "id string, safe boolean, t string")
    assert [r["id"] for r in sinks.unsafe_ids(d, "id", "safe").collect()] == ["a", "b"] and [r["id"] for r in sinks.publishable(d, "safe").collect()] == ["d"]
    for k in (1, 2):
        sinks.jsonl(d, str(tmp_path / f"j{k}"), ["id"])
    a, b = ("".join(p.read_text() for p in sorted((tmp_path / f"j{k}").glob("part-*"))) for k in (1, 2))
    assert a == b and a.count("\n") == 4
    ok, skipped = sinks.with_text(d, "t")
    assert ok.count() == 2 and skipped.first()["skipped"] == 2
    v = spark.createDataFrame([("k", [1.0], "p"), ("k", [1.0], "p")], "k string, v array<double>, p string")
    r = sinks.vector_points(v, "k", "v", str(uuid.NAMESPACE_URL), ["p"]).collect()
    assert len(r) == 1 and r[0]["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "k"))
    got = sinks.patched(d, spark.createDataFrame([("a", "new"), ("zz", "no")], "id string, t string"), "id", "t")
    assert got.count() == 4 and got.where("id = 'a'").first()["t"] == "new"
    q = spark.createDataFrame([("doc-a", "s", "c1")], "question_id string, statement string, category string")
    assert sinks.seed(spark, q, {"c1": "grace"})["UNDER_QUESTION"].first()["dst_id"] == "grace"
    with pytest.raises(ValueError):
        sinks.seed(spark, q, {"c2": "law"})
    e = spark.range(1).select(sinks.embed_text(F.lit("l"), F.lit("t"), F.lit("g"), F.lit("n"), F.lit(""), F.lit(None).cast("string")).alias("x")).first()["x"]
    assert e == "l (t) : g | pos n"
    spark.sql("CREATE DATABASE IF NOT EXISTS wipe_me")
    assert sinks.wipe(spark, "wipe_me") == 0


def test_sigla(spark):
    """A later hand is one last letter after letters alone or something with a digit; centuries go by ordered rules."""
    got = {r["s"]: (r["h"]["base"], r["h"]["hand"], r["c"]) for r in spark.createDataFrame([(x,) for x in ("206S", "01C2", "P74", "L1", "Byz", "A", "AV", "S", "01", "33", "206", "1739", "1V", "?S")], "s string").select("s", A.split_hand(F.col("s")).alias("h"), A.century_of(A.split_hand(F.col("s"))["base"]).alias("c")).collect()}
    assert got == {
        "206S": ("206", "C", 11), "01C2": ("01C2", None, 5), "P74": ("P74", None, 3), "L1": ("L1", None, 10), "Byz": ("Byz", None, 9), "A": ("A", None, 5), "AV": ("A", "C", 5), "S": ("S", None, 5),
        "01": ("01", None, 5), "33": ("33", None, 9), "206": ("206", None, 11), "1739": ("1739", None, 12), "1V": ("1", "C", 9), "?S": ("?S", None, 12),
    }


def test_damaged_pages(spark, tmp_path):
    (tmp_path / "p.html").write_bytes("<p>x (1) one\xf9two {**note (2)} three--four (#Ge 2:4). l\xf7ogos &amp; more (2) last <p>Go to the end (3) no".encode("latin-1"))
    got = {r["anchor_id"]: r["text"] for r in A.philo(spark, str(tmp_path / "p.html"), "philo.de-x")["HistoricalChunk"].collect()}
    assert got == {"philo.de-x.1": "one, two three, four. logos & more", "philo.de-x.2": "last"}
    (tmp_path / "t.xml").write_bytes('<TEI><body><milestone unit="chapter" n="1"/>C\xe6sar &mdash; &amp;c &#8212;x &Xy; z</body></TEI>'.encode("cp1252"))
    assert A.roman_historians(spark, str(tmp_path / "t.xml"))["HistoricalChunk"].first()["text"] == "Cæsar &c x z"


def test_sections_and_citations(spark, tmp_path):
    from quillgraph.plans import adapters

    x = """<TEI><text><body><div><div subtype='book' n='18'><div subtype='section' n='62'><p><milestone unit='Whiston_chapter' n='3'/><milestone unit='Whiston_section' n='2'/>before<note>no</note> it</p></div>
    <div subtype='section' n='63'><p><milestone unit='Whiston_section' n='3'/>A wise man. He was [the] Christ. And so on.</p></div><div subtype='section' n='64'><p>after</p></div></div></div></body></text></TEI>"""
    (tmp_path / "ant.xml").write_text(x)
    mark = {"josephus.ant.18.63": ("bracketed", "He was \\[the\\] Christ\\."), "josephus.ant.18.64": ("none there", "nothing like it")}
    t = adapters.josephus(spark, str(tmp_path / "ant.xml"), "ant", mark)
    got = {r["anchor_id"]: (r["anchor_alt_citation"], r["text_to_embed"], r["redact_for_embedding"]) for r in t["HistoricalChunk"].collect()}
    assert got == {"josephus.ant.18.62": ("Ant 18.3.2 (Whiston)", "before it", False), "josephus.ant.18.63": ("Ant 18.3.3 (Whiston)", "A wise man. And so on.", True)}
    assert [r["chunk_id"] for r in t["quarantine"].collect()] == ["josephus.ant.18.64"]
    assert "He was [the] Christ." in t["HistoricalChunk"].where("redact_for_embedding").first()["text"]


def test_structure_of_works(spark):
    from quillgraph.plans import adapters

    body = "a body that is long enough to count as text, with more words than eighty characters need to be there"
    pages = {
        "wcf": ("u", f"<h3 class='divider'><a name='Chapter_02'></a>CHAPTER 2<br><i>Of God</i></h3><p>1. {body}</p><p>goes on</p><p>2. second</p>"),
        "wsc": ("u", "<p>Q. 7. What are they? A. They are these.</p><p>Q. 7. Again? A. No.</p>"),
        "heidelberg": ("u", "<div>Q &amp; A 12<p>Q. Why?</p><p>A. Because.</p><p>1 Gen. 1:1</p><p>More.</p></div>"),
        "dort": ("u", "<h2>The First Main Point of Doctrine</h2><h3>Article 1: A</h3><p>one</p><h2>The Third and Fourth Main Points</h2><h3>Article 1: B</h3><p>three</p>"),
        "lbc_1689": ("http://x/1689/chapter12.html", "<h3>12. Of Adoption.</h3><p class='close'>1. All ( a ) those</p><p>2. no</p>"),
        "articles_39": ("u", "<div class='mw-parser-output'><div class='wst-center'>IV. Of the Resurrection.</div><p>He did</p><p>truly.</p></div><p>outside</p>"),
        "umc": ("u", "<h4><a name='x'></a>Article II&mdash;Of the Word</h4><p>The Son</p>"),
        "schleitheim": ("u", f"<body><p>I. {body.capitalize()}</p><p>and on</p><p>II. Short.</p></body>"),
        "vatican_dv": ("u", f"<p>3. {body}</p><p>3. again {body}</p><p>4. short</p>"),
        "bcp_1662": ("u", "<p><em>Question.</em> What? <em>Answer.</em> That.</p><p><em>Question.</em> Who?</p><p><em>Answer.</em> I.</p>"),
    }
    want = {
        "wcf": {"WCF.2.1": f"{body} goes on", "WCF.2.2": "second"}, "wsc": {"WSC.Q007": "Q. 7. What are they? A. They are these."}, "heidelberg": {"HC.Q012": "Q. 12. Why? A. Because. More."},
        "dort": {"Dort.1.A01": "one", "Dort.3.A01": "three"}, "lbc_1689": {"1689.12.1": "All those"}, "articles_39": {"39A.A04": "He did truly."}, "umc": {"UMC.A02": "The Son"},
        "schleitheim": {"Schleitheim.A1": f"{body.capitalize()} and on"}, "vatican_dv": {"DV.3": body}, "bcp_1662": {"BCP.Catechism.Q01": "Q. What? A. That.", "BCP.Catechism.Q02": "Q. Who? A. I."},
    }
    for work, (url, page) in pages.items():
        got = adapters.work_chunks(spark.createDataFrame([(url, page), (url + "0", None)], "url string, html string"), work)
        assert {r["anchor_id"]: r["text"] for r in got.collect()} == want[work], work
    embed = adapters.work_chunks(spark.createDataFrame([pages["lbc_1689"]], "url string, html string"), "lbc_1689").first()["text_to_embed"]
    assert embed == "Of Adoption. All those"
    p = "<p>" + "word " * 300 + "</p><p>short</p><p>Next page " + "x" * 60 + "</p>"
    s = adapters.stem_publishing(spark.createDataFrame([("https://h/authors/darby/work1.html", p), ("https://h/authors/darby/index.html", p)], "url string, html string")).collect()
    assert [r["anchor_id"] for r in s] == ["STEM.darby.work1.001"] and len(s[0]["text"].split()) == 300
    o = adapters.oca_hopko(spark.createDataFrame([("https://r/a/b", "<h1>T</h1><p>" + "y" * 120 + "</p><div class='page-footer'><p>" + "z" * 90 + "</p></div>"), ("https://r/c", "<p>few</p>"), ("https://q/a", p)], "url string, html string"), "https://r").collect()
    assert [(r["anchor_id"], len(r["text"]), r["redistribute"]) for r in o] == [("OCA.a.b", 120, False)]


def test_lines_of_split_files(spark, tmp_path):
    """Numbers go on from split to split, file by file; all kinds of line ends, a mark at the start, no last end."""
    from quillgraph.sources import text as lines

    (tmp_path / "a.txt").write_bytes(("﻿" + "".join(f"line {k} é\r\n" for k in range(5000)) + "last").encode())
    (tmp_path / "b.txt").write_text("one\n\nthree\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = lines.lines(spark, str(tmp_path / "*.txt"))
        got = sorted((r["file"].rsplit("/", 1)[-1], r["line_no"], r["line"]) for r in df.collect())
        assert df.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([*(("a.txt", k + 1, f"line {k} é") for k in range(5000)), ("a.txt", 5001, "last"), ("b.txt", 1, "one"), ("b.txt", 2, ""), ("b.txt", 3, "three")])
    (tmp_path / "l.dat").write_bytes("caf\xe9\nx\n".encode("latin-1"))
    assert [r["line"] for r in lines.lines(spark, str(tmp_path / "l.dat"), "ISO-8859-1").orderBy("line_no").collect()] == ["café", "x"]
