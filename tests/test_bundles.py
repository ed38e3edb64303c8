"""Parts of the lexical bundle that must not grow faster than their questions."""

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from quillgraph.functions import refs
from quillgraph.operators import retrieval
from quillgraph.plans import surface
from quillgraph.plans.registry import QUERIES


def test_neighbours_join_only_what_they_keep(spark, monkeypatch):
    """Of the lexemes of a question's domains only about as many are joined as its answer may have, and none of it is lost."""
    rows = [(f"s{d:02d}{k:03d}", f"l{k}", f"d{d:02d}") for d in range(30) for k in range(40)] + [(f"s{d:02d}000", "x", "a") for d in range(30)]
    domains = spark.createDataFrame(rows, "strong string, lemma string, domain_code string")
    anchors = {f"q{n}": {f"s{d:02d}{(n + k) % 40:03d}" for d in range(n, 30) for k in range(2)} for n in range(20)}
    top = spark.createDataFrame([(q, s) for q, x in anchors.items() for s in x], "question_id string, strong string")
    joined, plain = [], retrieval.top
    monkeypatch.setattr(retrieval, "top", lambda df, by, *rest: (joined.append(df.count()) if by == ["question_id"] else None, plain(df, by, *rest))[1])
    got = {}
    for r in surface.neighbours(domains, top, 5, 60).collect():
        got.setdefault(r["question_id"], []).append((r["rank"], r["code"], r["strong"]))
    for q, mine in anchors.items():
        codes = {c for s, _, c in rows if s in mine}
        want = sorted({(c, s) for s, _, c in rows if c in codes and s not in mine})[:5]
        assert [x[1:] for x in sorted(got[q])] == want
    assert sum(joined) <= 20 * 5 * 2


def test_rows_that_several_parts_read_are_made_once(spark, sf_dir):
    """Order lines are joined to their orders once, and anchors are taken apart once, not once for each part."""
    got = QUERIES["tool_lexical_bundle"](spark, sf_dir)
    assert not any("lineitem" in f for f in got.inputFiles())
    assert "regexp_extract" not in got.select("question_id", "part", "rank")._jdf.queryExecution().optimizedPlan().toString()


def test_a_reference_is_taken_apart_once(spark):
    """Each part of a reference has one regular expression, and none is cast that isn't there."""
    df = spark.createDataFrame([("John 1:1-3",), ("3 John 1:2",), ("Job 2:5-4",), ("Nowhere 1:1",), ("John 1",), (None,), ("John 1:99999999999",)], "human string")
    got = df.select(refs.to_keys(F.col("human")).alias("keys"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 5
    assert [r["keys"] for r in got.collect()] == [["John.1.1", "John.1.2", "John.1.3"], ["3John.1.2"], [], [], [], [], []]
