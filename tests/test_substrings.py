"""Substring search against plain Python, and the walk over a graph against its own breadth-first search."""

import random

import pytest

from quillgraph.operators import graph, substrings


@pytest.mark.parametrize("block", [None, 7])
def test_contained(spark, block):
    rng = random.Random(1)
    letters = "abcé🙂"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    terms = [word(rng.randint(1, 4)) for _ in range(60)] + ["", None, "nowhere to be found"]
    texts = [(k, word(rng.randint(0, 60))) for k in range(80)] + [(90, None), (91, ""), (92, "x" * 50_000 + "abc"), (92, "abc")]
    got = substrings.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms * 2], "term string"), block_terms=block)
    assert got.columns == ["id", "term"]
    want = [(i, t) for i, x in texts for t in sorted({t for t in terms if t is not None}) if x is not None and t in x]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = spark.createDataFrame([], "term string")
    assert substrings.contained(spark.createDataFrame(texts, "id long, text string"), none).count() == 0


def test_many_terms(spark):
    texts = spark.range(200).selectExpr("id", "concat('t', id, ' u', id + 1, '.') AS text")
    terms = spark.range(5000).selectExpr("concat('t', id, ' ') AS term")
    got = substrings.contained(texts, terms, block_terms=1000)
    assert got.count() == 200  # over the former bound of a broadcast, in five blocks


def test_reached(spark, tmp_path):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(230)} | {(k, k + 1) for k in range(300, 330)})
    seeds = [3, 5, 300, 999]
    want, front = dict.fromkeys(seeds, 0), set(seeds)
    for h in range(1, 26):
        front = {b for a, b in edges if a in front} - set(want)
        want |= dict.fromkeys(front, h)
    df = spark.createDataFrame(edges, "src_id long, dst_id long")
    start = spark.createDataFrame([(s,) for s in seeds], "id long")
    got = {r["id"]: r["hop"] for r in graph.reached(df, start, 25, f"file://{tmp_path}/a").collect()}
    assert got == {k: h for k, h in want.items() if h} and max(got.values()) == 25
    few = graph.reached(df.where("src_id >= 300"), start, 50, f"file://{tmp_path}/b")
    assert few.count() == 30 and len(list((tmp_path / "b").glob("hop=*"))) == 32  # ends after the first empty hop
    assert graph.reached(df, start.limit(0), 5, f"file://{tmp_path}/c").count() == 0
