"""The corpus pipeline: stages by themselves and in a row, and the registered queries."""

import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quillgraph.llm import queries


def test_names():
    assert [n for n in queries.QUERIES] == [f"op{k}_{n.split('_', 1)[1]}" for k, n in enumerate(queries.QUERIES, 1)]
    assert set(queries.ORACLES) <= set(queries.QUERIES) and "pipeline" in entry.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_sql(spark, sf_dir, duck):
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf_dir), duck.sql(sql)
        order = sorted(got.columns)
        assert order == sorted(want.columns)
        at = [want.columns.index(c) for c in order]
        assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", None), (10**6 + 1, "1234 !!", None, None, 3), (None, "And the other one is here with them in that house.", "en", None, 1)], docs.schema)
    now = docs.unionByName(odd).withColumn("extra", F.lit("x"))
    before = now.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == now.columns, name
        if name == "language ID":
            assert out.where("text IS NULL OR doc_id = 1000001").count() == 0 and out.count() == before - 2
        out = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < out.count() <= now.count(), name
        now = out
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = corpus_pipeline.run(spark, sf_dir)
    assert 0 < whole.count() < docs.count() and tok.get_vocab_size() > 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_language_id_keeps_short_texts(spark):
    text = "And the other one is here with them in that house. De la casa. A man and a dog were in it. "
    rows = [(k, text * 5, "en") for k in range(5)] + [(10, "De.", None), (11, "A.", None), (12, "In", None), (13, "ЖЖЖЖ ЖЖЖЖЖ", None), (14, "Ж.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    long = spark.createDataFrame([(20, " ".join(f"w{i}ab cd{i}" for i in range(2000)), "en")], docs.schema)  # a longer reference
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(long), "").collect()}
    assert {0, 10, 11, 12} <= kept and not {13, 14} & kept


def test_stages_judge_rows_and_not_ids(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "the garden was quiet and nobody had seen the grey cat since the early morning of that day"
    rows = [(None, f"Once {item} again", 1), (None, clean, 2), (4, item, 3), (4, clean + " or so they said to us", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    assert sorted(r["extra"] for r in corpus_pipeline.decontaminate(spark, docs, sf_dir).collect()) == [2, 4]
    copies = spark.createDataFrame([(None, clean, 1), (2, clean, 2), (None, "another text without an id that is kept as it is", 3), (2, "one more text", 4)], docs.schema)
    assert sorted(r["extra"] for r in corpus_pipeline.dedup_documents(spark, copies, sf_dir).collect()) == [2, 3, 4]
