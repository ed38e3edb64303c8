"""The vector index: exact for any data, and few pairs where vectors are in clusters."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import cells, retrieval


def vectors(rng, n, clusters, noise, dims=16):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    return [[x + rng.gauss(0, noise) for x in rng.choice(centres)] for _ in range(n)]


def tables(spark, rng, n, q, clusters, noise):
    rows = vectors(rng, n, clusters, noise)
    items = spark.createDataFrame([(k, v, k % 5) for k, v in enumerate(rows)] + [(n, [0.0] * 16, 1), (n + 1, rows[0], 1)], "id long, vector array<double>, label int")
    asked = [*rows[:q], [0.0] * 16]
    return items, spark.createDataFrame(list(enumerate(asked)), "query_id long, vector array<double>")


@pytest.mark.parametrize(("clusters", "noise", "pivots", "k"), [(20, 0.05, 16, 5), (1, 1.0, 8, 10), (3, 0.3, 1, 3), (40, 0.01, 64, 700)])
def test_search_is_exact(spark, tmp_path, clusters, noise, pivots, k):
    items, asked = tables(spark, random.Random(pivots), 600, 25, clusters, noise)
    index = cells.build(items, f"file://{tmp_path}/i", pivots, ["label"])
    row = lambda r: (r["query_id"], r["id"], r["rank"], round(r["score"], 5))
    want = sorted(map(row, retrieval.dense(asked, items, k).collect()))
    assert sorted(map(row, cells.search(index, asked, k).collect())) == want
    some = sorted(map(row, retrieval.dense(asked, items.where("label < 2"), k).collect()))
    assert sorted(map(row, cells.search(cells.opened(spark, f"file://{tmp_path}/i"), asked, k, F.col("label") < 2).collect())) == some


def test_clusters_leave_most_pairs_out(spark, tmp_path):
    items, asked = tables(spark, random.Random(2), 3000, 40, 30, 0.05)
    index = cells.build(items, f"file://{tmp_path}/i", 64)
    assert cells.candidates(index, asked.where("query_id < 40"), 10).count() < 0.15 * 3000 * 40


def test_empty_tables(spark, tmp_path):
    items, asked = tables(spark, random.Random(3), 5, 2, 1, 0.1)
    index = cells.build(items.limit(0), f"file://{tmp_path}/i", 4)
    assert cells.search(index, asked, 3).count() == 0
    assert cells.search(cells.build(items, f"file://{tmp_path}/j", 4), asked.limit(0), 3).count() == 0
