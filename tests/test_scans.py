"""Prefix scans over splits, and what rests on them, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ordered
from quillgraph.plans.registry import QUERIES
from quillgraph.sources import text, textfabric
from tests.test_plans import plan


@pytest.mark.parametrize("span", [1, 3, 64, 1 << 16])
def test_scan(spark, span):
    rng = random.Random(span)
    rows = [(g, at, rng.choice([None, at * 10]), rng.random() < 0.3) for g in "abc" for at in sorted(rng.sample(range(300), 80))]
    df = spark.createDataFrame(rows, "g string, at int, v long, hit boolean").repartition(5)
    got = {(r["g"], r["at"]): (r["n"], r["k"], r["seen"]) for r in ordered.scan(df, ["g"], "at", {"n": F.col("hit"), "k": F.lit(True)}, {"seen": F.col("v")}, span).collect()}
    want, state = {}, {}
    for g, at, v, hit in rows:
        n, k, seen = state.get(g, (0, 0, None))
        state[g] = want[g, at] = (n + hit, k + 1, seen if v is None else v)
    assert got == want
    assert ordered.scan(df.limit(0), ["g"], "at", {"n": F.col("hit")}, {}, span).count() == 0


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_owner_takes_the_last_start_and_then_the_end(spark, width):
    rng = random.Random(width)
    spans = [(lo := rng.randrange(400), lo + rng.choice([0, 3, 50, 400]), k) for k in range(60)] + [(None, 5, 99)]
    points = [(k, rng.randrange(-20, 500)) for k in range(300)] + [(900, None), (901, 5), (901, 5)]
    got = sorted((r["id"], r["at"], r["span"]) for r in ordered.owner(spark.createDataFrame(points, "id long, at long"), spark.createDataFrame(spans, "lo long, hi long, span long"), "at", "lo", "hi", width).collect() if r["at"] is not None)

    def brute(at):
        before = [s for s in spans if s[0] is not None and s[0] <= at]
        lo = max((s[0] for s in before), default=None)
        last = max((s for s in before if s[0] == lo), key=lambda s: (s[1], s[2]), default=None)
        return last[2] if last and last[1] >= at else None

    key = lambda r: (r[0], r[1], -1 if r[2] is None else r[2])
    assert sorted(got, key=key) == sorted(((i, at, brute(at)) for i, at in points if at is not None), key=key)
    one = ordered.owner(spark.createDataFrame(points, "id long, at long"), spark.createDataFrame(spans, "lo long, hi long, span long"), "at", "lo", "hi", width)
    assert one.where("at IS NULL").select("id", "span").collect() == [(900, None)] and one.count() == len(points)


def test_part_files_are_one_source(spark, tmp_path):
    lines = [f"line {k}" for k in range(1000)]
    df = spark.createDataFrame(list(enumerate(lines)), "at long, line string")
    df.repartitionByRange(4, "at").sortWithinPartitions("at").select("line").write.text(f"file://{tmp_path}/one.txt")
    got = text.lines(spark, f"file://{tmp_path}/one.txt").collect()
    assert sorted((r["line_no"], r["line"]) for r in got) == [(k + 1, x) for k, x in enumerate(lines)] and len({r["file"] for r in got}) == 1


def test_node_features_over_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered.scan, "__defaults__", (None, None, 7))
    rng, said, want, node = random.Random(8), [], [], 0
    for k in range(400):
        if rng.random() < 0.1:
            node = rng.randrange(1000, 5000)
            hi = node + rng.choice([0, 0, 3])
            said.append(f"{node}-{hi}\tv{k}" if hi > node else f"{node}\tv{k}")
            want += [(n, f"v{k}") for n in range(node, hi + 1)]
            node = hi
        else:
            node += 1
            blank = rng.random() < 0.1
            said.append("" if blank else f"v{k}")
            want += [] if blank else [(node, f"v{k}")]
    (tmp_path / "f.tf").write_text("@node\n\n" + "\n".join(said) + "\n")
    body = text.after_header(text.lines(spark, str(tmp_path / "f.tf")), F.col("line_no") == 2)
    assert sorted((r["node"], r["value"]) for r in textfabric.node_feature(body).collect()) == sorted(want)


def test_no_window_takes_a_whole_file(spark, sf_dir):
    """Windows by file alone are over the table of splits: their rows have no line."""
    for name in ("adapter_bhsa", "adapter_stepbible_tbesh", "adapter_stepbible_morph_codes", "adapter_stepbible_proper_nouns", "adapter_coptic_scriptorium", "adapter_etcbc_parallels"):
        windows = re.findall(r"\(\d+\) Window\s*\nInput \[\d+\]: \[([^\]]*)\]\nArguments: \[[^\n]*\], \[(file#\d+)\]", plan(QUERIES[name](spark, sf_dir)))
        assert windows and not any(re.search(r"\bline#", i) for i, _ in windows), name
