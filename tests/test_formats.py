"""The SQLite source, and table functions against the column functions of the same parsers."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import formats, markup, textfabric, works


def database(path, rows):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a TEXT, n INTEGER, x REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
        db.execute("DELETE FROM t WHERE n % 7 = 3")  # gaps between row ids
        db.execute("CREATE TABLE none (a TEXT)")


@pytest.mark.parametrize("n", [1, 3, 50])
def test_sqlite_source(spark, tmp_path, n):
    rows = [(f"é{k}" if k % 5 else None, k, k / 2) for k in range(100)]
    database(tmp_path / "a b.db", rows)
    formats.register(spark)
    reader = spark.read.format("sqlite_table").option("dbtable", "t").option("numPartitions", n)
    df = reader.schema("n int, a string, x double").load(str(tmp_path / "a b.db"))
    assert sorted(map(tuple, df.collect())) == sorted(((k, a, x) for a, k, x in rows if k % 7 != 3))
    assert df.rdd.getNumPartitions() == n and df.where("a IS NULL").count() == sum(a is None and k % 7 != 3 for a, k, _ in rows)
    assert reader.schema("n int").load(f"file://{tmp_path}/a b.db".replace(" ", "%20")).count() == df.count()
    assert spark.read.format("sqlite_table").option("dbtable", "none").schema("a string").load(str(tmp_path / "a b.db")).count() == 0
    with pytest.raises(Exception, match="letters"):
        spark.read.format("sqlite_table").option("dbtable", "t; drop").schema("a string").load(str(tmp_path / "a b.db")).count()


def test_table_functions(spark, tmp_path):
    formats.register(spark)
    xml = "<osis><verse osisID='Gen.1.1'><w id='1' lemma='a'>x</w><w type='x-ketiv'>k</w><note><rdg><w>q</w></rdg></note></verse><verse osisID='Gen.1.2'/></osis>"
    html = "<html><body><h3>Article 1: One</h3><p>" + "word " * 30 + "</p><h3>Article 2: Two</h3><p>" + "more " * 30 + "</p></body></html>"
    spark.createDataFrame([(1, xml, html), (2, None, None), (3, "<osis/>", "")], "id int, xml string, html string").createOrReplaceTempView("udtf_docs")
    got = spark.sql("SELECT d.id, w.* FROM udtf_docs d, LATERAL osis_words(d.xml) w")
    want = spark.table("udtf_docs").select("id", F.explode(markup.osis_words("xml")).alias("w")).select("id", "w.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3
    got = spark.sql("SELECT d.id, p.* FROM udtf_docs d, LATERAL work_parts(d.html, 'belgic') p")
    want = spark.table("udtf_docs").select("id", F.explode(works.parts("belgic")("html")).alias("p")).select("id", "p.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2
    lines = [(f, k, x) for f in "ab" for k, x in enumerate(["p", "", "10-12\tq", "r", "20\ts", " ", "t"], 1)]
    rows = spark.createDataFrame(lines, "file string, line_no int, line string").repartition(5)
    rows.createOrReplaceTempView("udtf_lines")
    got = spark.sql("SELECT * FROM tf_nodes(TABLE(udtf_lines) PARTITION BY file ORDER BY line_no)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, textfabric.node_feature(rows).collect()))
