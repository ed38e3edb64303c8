"""What stands between milestones, in one pass over a text."""

import time

from pyspark.sql import functions as F

from quillgraph.sources import markup


def test_milestones_take_one_pass(spark):
    n = 20_000
    whole = "before" + "".join(f'<m n="{k}"/> text {k} ' for k in range(n))
    df = spark.createDataFrame([(whole,), ("no mark",), (None,)], "x string")
    start = time.monotonic()
    got = df.select(F.explode(markup.milestones(F.col("x"), '<m n="(\\d+)"/>')).alias("m")).select("m.n", "m.text").collect()
    assert time.monotonic() - start < 20
    assert [(r["n"], r["text"]) for r in got] == [(str(k), f"text {k}") for k in range(n)]
