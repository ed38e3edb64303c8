"""Near ties go by all candidates that are near, however many they are."""

import pytest

from quillgraph.operators import nearest, retrieval
from quillgraph.plans import surface


@pytest.mark.parametrize("most", [1 << 14, 16])
def test_a_near_vector_behind_many_others_is_found(spark, monkeypatch, most):
    monkeypatch.setattr(nearest, "ITEMS", most)
    at = lambda n: [1.0, n / 1000]  # noqa: E731  within the band of 0.04 up to 280
    rows = [(f"cult-{n:03d}", at(n)) for n in range(120)] + [("doc-a", at(130)), ("doc-b", at(140)), ("doc-far", [0.0, 1.0])]
    questions = spark.createDataFrame(rows, "question_id string, vector array<double>")
    asked = spark.createDataFrame([(1, at(0)), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "query_id long, vector array<double>")
    got = {r["query_id"]: (r["matched"], r["confidence"]) for r in surface.classify(asked, questions).collect()}
    assert got == {1: ("doc-a", "ambiguous"), 2: ("doc-far", "high"), 3: (None, "none")}
    ranked = retrieval.dense(asked, questions.withColumnRenamed("question_id", "id"), len(rows))
    assert got == {r["query_id"]: (r["matched"], r["confidence"]) for r in retrieval.assess(ranked, "semantic").collect()}


def test_a_near_question_behind_many_others_is_found(spark):
    rows = [(f"cult-{n:03d}", "grace and works") for n in range(60)] + [("doc-z", "grace and works"), ("doc-other", "angels")]
    questions = spark.createDataFrame(rows, "question_id string, statement string")
    asked = spark.createDataFrame([(1, "are grace works"), (2, "angels"), (3, "zzz")], "query_id long, proposition string")
    got = {r["query_id"]: (r["matched"], r["confidence"]) for r in surface.classify(asked, questions).collect()}
    assert got == {1: ("doc-z", "ambiguous"), 2: ("doc-other", "high"), 3: (None, "none")}
