"""Numbers of messages from a stream with state: late and repeated turns, several runs, and a restart."""

import random

import pytest

from quillgraph.streaming import turns

SCHEMA = "conv_id long, turn int, role string, text string"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def got(spark, out):
    return sorted((r["conv_id"], r["turn"], r["n"], r["role"]) for r in turns.latest(spark, out).collect())


def brute(rows):
    roles = {}
    for c, t, r, _ in rows:
        if t is not None:
            roles.setdefault(c, {})[t] = min(filter(None, (r, roles.get(c, {}).get(t))), default=None)
    return sorted((c, t, n, ts[t]) for c, ts in roles.items() for n, t in enumerate(sorted(ts), 1))


def test_late_and_repeated_turns_over_runs(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("source", "out", "mark"))
    rng, rows = random.Random(1), []
    before = spark.conf.get(turns.STORE)
    for run in range(3):
        for _ in range(2):
            some = [(rng.randrange(8), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", None]), "x") for _ in range(25)]
            put(spark, source, some)
            rows += some
        turns.number_files(spark, source, SCHEMA, out, mark, files_per_batch=1)
        assert got(spark, out) == brute(rows), run  # each run is a new query that goes on with the state
    assert spark.conf.get(turns.STORE) == before
    turns.number_files(spark, source, SCHEMA, out, mark)
    assert got(spark, out) == brute(rows)


@pytest.mark.parametrize("batches", [1, 4])
def test_conversations(spark, sf_dir, tmp_path, batches):
    """The given conversations, dealt over files, get the numbers of the batch query."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id", "CAST(turn AS INT) AS turn", "role", "text")
    c.repartition(batches, "text").write.parquet(f"file://{tmp_path}/source")
    turns.number_files(spark, f"file://{tmp_path}/source", SCHEMA, f"file://{tmp_path}/out", f"file://{tmp_path}/mark", files_per_batch=1)
    assert got(spark, f"file://{tmp_path}/out") == brute([tuple(r) for r in c.collect()])
