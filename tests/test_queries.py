"""Every registered query against its SQL, or for rows and a stable schema."""

import math

import pytest

import __spark_entry__ as entry
from quillgraph.plans.registry import QUERIES, SQL


def said(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([[said(r[i]) for i in order] for r in data])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_two_runs_agree(spark, sf_dir):
    from quillgraph.operators.checks import snapshot

    for name in ("cross_ref_votes", "balanced_union", "snapshot_hash"):
        a, b = (snapshot(QUERIES[name](spark, sf_dir)).first() for _ in range(2))
        assert a == b, name
