"""Exact search by blocks: against plain Python, with ties, copies, zero and unknown vectors; and no plan that scores pair by pair."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from quillgraph.operators import nearest, retrieval
from quillgraph.plans.registry import QUERIES


def score(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    la, lb = (math.sqrt(sum(x * x for x in v)) or 1.0 for v in (a, b))
    return float(Decimal(repr(sum(x / la * (y / lb) for x, y in zip(a, b)))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


@pytest.mark.parametrize(("k", "most"), [(3, 16), (1, 7), (40, 1 << 14)])
def test_blocks_are_exact(spark, monkeypatch, k, most):
    rng = random.Random(k)
    some = [[float(rng.randint(-2, 2)) for _ in range(4)] for _ in range(40)] + [[0.0] * 4, None, [1.0, None, 0.0, 0.0], [1.0, 2.0]]
    rows = [(n, rng.choice(some), n % 3) for n in range(300)]
    asked = [(n, v) for n, v in enumerate([*some[:6], *some[40:]])]
    items, queries = spark.createDataFrame(rows, "id long, vector array<float>, g int"), spark.createDataFrame(asked, "query_id long, vector array<float>")
    monkeypatch.setattr(nearest, "ITEMS", most * 4)
    monkeypatch.setattr(nearest, "QUERIES", most)
    order = lambda r: (r[2] is None, -(r[2] or 0.0), r[1])
    whole, grouped = [], []
    for q, a in asked:
        pairs = sorted(((q, n, score(a, v), g) for n, v, g in rows), key=order)
        whole += [(*p[:3], r) for r, p in enumerate(pairs[:k], 1)]
        for g in range(3):
            grouped += [(*p, r) for r, p in enumerate([p for p in pairs if p[3] == g][:k], 1)]
    at = lambda r: r[:2]
    assert sorted(map(tuple, retrieval.dense(queries, items, k).select("query_id", "id", "score", "rank").collect()), key=at) == sorted(whole, key=at)
    assert sorted(map(tuple, retrieval.dense_by_group(queries, items, "g", k).select("query_id", "id", "score", "g", "rank").collect()), key=at) == sorted(grouped, key=at)


@pytest.mark.parametrize("name", ["cosine_topk", "filtered_topk", "per_type_topk", "balanced_union", "indexed_topk", "rrf_hybrid", "hybrid_expand", "question_match", "tool_retrieve_chunks", "tool_cultural_overlay", "tool_debate_for_verse", "tool_historical_bundle"])
def test_pairs_are_scored_in_blocks(spark, sf_dir, name):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroupsInArrow" in text and "zip_with(v#" not in text
