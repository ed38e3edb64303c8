"""Hand-made cases for functions and operators."""

import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.functions import licence, refs, strongs, text, vectors
from quillgraph.operators import checks, graph, ordered, retrieval, verdict
from quillgraph.sources import markup, textfabric
from quillgraph.sources import text as lines


def one(spark, expr, **cols):
    df = spark.createDataFrame([Row(**cols)]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, lang, want", [("H430", None, ("H0430", None)), ("{H1254a}", None, ("H1254A", "A")), ("746", "gk", ("G0746", None)), ("746", None, (None, None)), ("1254 a", "hb", ("H1254A", "A")), ("a/H1961", None, ("H1961", None)), ("12345", "hb", ("H12345", None)), ("", "hb", (None, None)), ("x1", "hb", (None, None))])
def test_strongs(spark, raw, lang, want):
    assert tuple(one(spark, strongs.canonical(F.lit(raw), F.lit(lang).cast("string")))) == want


@pytest.mark.parametrize("slug, mode, n, of, ok", [("public_domain", "bulk", 0, 0, True), ("CC-BY-NC-4.0", "bulk", 0, 0, False), ("CC-BY-NC-4.0", "snippet", 50, 5000, True), ("CC-BY-NC-4.0", "snippet", 51, 5000, False), ("CC-BY-NC-4.0", "snippet", 101, 10**6, False), ("macula-hebrew", "bulk", 0, 0, False), ("SBLGNT-EULA", "snippet", 0, 0, True), ("© someone", "snippet", 1, 100, True), ("nothing known", "snippet", 1, 100, False), ("", "bulk", 0, 0, False), (None, "bulk", 0, 0, False), ("pd", "other", 0, 0, False)])
def test_licence(spark, slug, mode, n, of, ok):
    got = one(spark, licence.guard(F.lit(slug).cast("string"), mode, n, of))
    assert got["allowed"] is ok and got["reason"]


def test_empty_sources_differ_by_caller(spark):
    none = F.array().cast("array<struct<source:string,license:string>>")
    assert one(spark, licence.envelope(none, F.lit("personal")))["response_safe_to_share"] is False
    assert one(spark, licence.rollup(none, True)) is True and one(spark, licence.rollup(none, False)) is False


def test_refs(spark):
    assert one(spark, refs.to_keys(F.lit("John 1:1-3"))) == ["John.1.1", "John.1.2", "John.1.3"]
    assert one(spark, refs.to_keys(F.lit("John 1:3-1"))) == [] and one(spark, refs.to_keys(F.lit("Nowhere 1:1"))) == []
    assert [tuple(r) for r in one(spark, refs.expand(F.lit("Gen.1.1-3,7,9-8,x")))] == [("Gen", 1, 1), ("Gen", 1, 2), ("Gen", 1, 3), ("Gen", 1, 7)]
    assert one(spark, refs.expand(F.lit("Gen.1.1-2000"))) == []
    assert one(spark, refs.humanise(F.lit("John.1.3"))) == "John 1:3"
    assert one(spark, refs.in_scope(F.array(F.lit("3John.1.4")), "3John", 1, 1, 15)) is True


def test_text(spark):
    assert one(spark, text.slugify(F.lit("  Ünder the Hill! "))) == "nder-the-hill"
    assert one(spark, text.slugify(F.lit("??"))) == "unknown"
    assert one(spark, text.snippet(F.lit("a b c d"), F.lit(250))) == "a b"
    assert one(spark, text.snippet(F.lit("a b c d"), F.lit(0))) == "a b c d"
    assert one(spark, text.without_brackets(F.lit("a [b [c] d] e")))["text"] == "a e"
    assert one(spark, text.without_accents(F.lit("éλύ"))) == "eλυ"
    assert one(spark, text.alternatives(F.lit("a OR b / c"))) == ["a", "b / c"]
    assert one(spark, text.without_span(F.lit("a b c"), "b"))["ok"] is True


def test_vectors(spark):
    assert one(spark, vectors.uuid5(str(uuid.NAMESPACE_DNS), F.lit("é.org"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "é.org"))
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    a, b = (one(spark, vectors.digest(F.array(F.lit(x)))) for x in (0.0, -0.0))
    assert a == b


def test_packing(spark):
    got = one(spark, ordered.packed(F.array(*map(F.lit, (60, 500, 10, 600, 5)))))
    assert [g["words"] for g in got] == [560, 610, 5]
    assert one(spark, ordered.packed(F.array().cast("array<int>"))) == []


def test_sequences(spark):
    assert one(spark, ordered.expected_next(F.array(*map(F.lit, (2, 1, 3, 2, 2, 3, 9))))) == [1, 2, 3]
    df = spark.createDataFrame([("v", 1, "1"), ("v", 2, "1"), ("v", 3, "1")], "b string, n int, l string")
    assert [r["x"] for r in ordered.sub_letter(df, ["b"], "l", ["n"], "x").orderBy("n").collect()] == ["1", "1b", "1c"]
    assert one(spark, ordered.padded(F.lit(123))) == "123"


def test_textfabric_blank_lines(spark):
    rows = spark.createDataFrame([("f", k, v) for k, v in enumerate(["a", "", "b", "9\tc", "d"], 1)], "file string, line_no int, line string")
    got = lambda count: sorted((r["node"], r["value"]) for r in textfabric.node_feature(rows, count).collect())
    assert got(True) == [(1, "a"), (3, "b"), (9, "c"), (10, "d")]
    assert got(False) == [(1, "a"), (2, "b"), (9, "c"), (10, "d")]


def test_line_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes("﻿id\tname\n1\tx\n\n2\n".encode())
    got = lines.tsv(spark, str(tmp_path / "a.tsv"), ["id", "name"]).orderBy("line_no").collect()
    assert [(r["id"], r["name"]) for r in got] == [("1", "x"), ("2", "")]
    (tmp_path / "b.txt").write_text("prose\n$A one\nx\n$B two\ny\nz\n")
    got = lines.blocks(lines.lines(spark, str(tmp_path / "b.txt")), F.col("line").startswith("$")).orderBy("block").collect()
    assert [(r["head"], r["details"]) for r in got] == [("$A one", ["x"]), ("$B two", ["y", "z"])]


def test_markup(spark, tmp_path):
    page = "<html><head><title>T</title><script>x<y</script></head><body><nav><a href='#a'>n</a></nav><article><h2>Article 1</h2><p>One &amp; two<h2>II. Next</h2><p>Three</article></body></html>"
    assert one(spark, markup.html_text(F.lit("<p>a<b>b</b></p>c<style>z</style>"))) == "ab c"
    m = one(spark, markup.main_content(F.lit(page)))
    assert m["title"] == "T" and "nav" not in m["text"] and m["text"].startswith("Article 1")
    s = one(spark, markup.sections(F.lit(page)))
    assert [(x["number"], x["text"]) for x in s] == [(1, "One & two"), (2, "Three")]
    assert one(spark, markup.absolute(F.lit("http://h/a/b.html"), F.lit("c.html"))) == "http://h/a/c.html"
    osis = "<o><verse osisID='Gen.1.1'><w id='1' type='x-ketiv'>k</w><note><rdg><w id='2'>q</w></rdg></note><w id='3'>r</w></verse></o>"
    assert [(w["id"], w["kind"]) for w in one(spark, markup.osis_words(F.lit(osis)))] == [("1", "ketiv"), ("2", "qere"), ("3", "word")]
    tei = "<body><div n='1'><div n='2'><p>a<note>x</note>b</p></div></div></body>"
    assert [tuple(x) for x in one(spark, markup.tei_sections(F.lit(tei)))] == [("1.2", "ab")]
    (tmp_path / "d.json").write_text('{"a": 1}')
    assert markup.json_docs(spark, str(tmp_path / "d.json"), "a int").first()["a"] == 1
    assert markup.decode(b"\xe9\x80") == "é€"


def test_graph(spark):
    base = spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "id string, p string, q string")
    new = spark.createDataFrame([("b", None, "y"), ("c", "3", None)], "id string, p string, q string")
    got = sorted(map(tuple, graph.upsert(base, new, ["id"]).collect()))
    assert got == [("a", "1", None), ("b", "2", "y"), ("c", "3", None)]
    assert graph.attach(base, spark.createDataFrame([("z", "9")], "id string, q string"), ["id"]).count() == 2
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src_id string, dst_id string")
    assert sorted(map(tuple, graph.neighbours(e, base.where("id = 'a'").select("id"), 2).collect())) == [("b", 1), ("c", 2)]


def test_verdicts(spark):
    s = one(spark, verdict.breadth(F.lit(True), F.lit(True), F.lit(8), F.lit(12), F.lit(10), F.lit(0), F.lit(0)))
    assert s == 1.0 and one(spark, verdict.band(F.lit(s), F.lit(True))) == "canon_wide" and one(spark, verdict.band(F.lit(s), F.lit(False))) == "broad"
    assert one(spark, verdict.stability(F.lit("n/a"), F.lit(True))) == "not_in_scope"
    tags = F.array(*(F.struct(F.lit(d).alias("doctrine"), F.lit(c).alias("confidence")) for d, c in (("a", 0.7), ("b", 0.9), ("c", 0.1))))
    assert [t["doctrine"] for t in one(spark, verdict.top_tags(tags))] == ["b", "a"]
    assert one(spark, verdict.best_tag(tags, F.lit("a")))["doctrine"] == "a"


def test_adapter_checks_catch_bad_output(spark):
    good = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, lemma string")
    edges = spark.createDataFrame([("1", "2")], "src_id string, dst_id string")
    fails = lambda n, e: {r["name"] for r in checks.adapter_checks(n, {"lemma": "string"}, "lemma", e, 1).where("NOT ok").collect()}
    assert fails(good, edges) == set()
    assert fails(good.limit(0), edges) >= {"rows", "distinct lemmas"}
    assert fails(good.withColumn("lemma", F.lit("x")), edges) == {"distinct lemmas"}
    assert fails(good.withColumn("lemma", F.lit(" ")), edges) >= {"lemma filled"}
    assert fails(good.union(good), edges) == {"unique ids"}
    assert fails(good, edges.limit(0)) == {"edges"}


def test_checks(spark):
    assert one(spark, checks.filled("float", F.lit(float("inf")))) is False and one(spark, checks.filled("string", F.lit(" "))) is False
    with pytest.raises(KeyError):
        checks.filled("nothing", F.lit(1))
    with pytest.raises(ValueError):
        checks.bounds("limit", 0, 1, 200)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert checks.snapshot(df).first() == checks.snapshot(df.orderBy(F.desc("x"))).first() != checks.snapshot(df.limit(1)).first()


def test_routing_and_validation(spark):
    assert one(spark, retrieval.route(F.lit("variant of the doctrine of grace")))["intent"] == "variant_inspect"
    with pytest.raises(ValueError):
        retrieval.bounded(spark.range(5), 4)
    v = schemas.validated(spark.createDataFrame([("a",), (None,)], "x string"), [("filled", F.col("x") != "")])
    ok, bad = schemas.split_valid(v)
    assert ok.count() == 1 and bad.first()["_violations"] == ["filled"]


def test_streams(spark, tmp_path):
    from quillgraph.streaming import ingest

    schema = spark.createDataFrame([(1, 1, "a")], "k int, v int, s string").schema
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).write.parquet(src)
    assert ingest.ingest(spark, src, schema, out, ck) == 2
    spark.createDataFrame([(1, 2, "c")], schema).write.mode("append").parquet(src)
    assert ingest.ingest(spark, src, schema, out, ck) == 1 and spark.read.parquet(out).count() == 3
    ingest.merge_latest(spark, src, schema, f"{out}-m", f"{ck}-m", ["k"], "v", 4)
    assert {(r["k"], r["s"]) for r in ingest.merged(spark, schema, f"{out}-m").collect()} == {(1, "c"), (2, "b")}
