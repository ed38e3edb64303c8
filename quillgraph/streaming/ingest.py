"""Resumable ingest and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pattern(path: str) -> str:
    """A pattern that stands for the path alone: a stream takes a folder by its name, but one file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, transform=None) -> int:
    """Append what is new under ``source`` to ``target``; files of earlier runs are known by the checkpoint. Gives the
    number of rows that this run read."""
    stream = spark.readStream.schema(schema).parquet(source)
    out = transform(stream) if transform else stream
    q = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def merge_latest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: list[str], order: str, parts: int = 32) -> None:
    """Keep the last row of each key over all runs, under ``target`` by the batch that wrote it and the key's partition.

    A batch merges its rows with the newest state of the key partitions that it touches, and writes these under its own number;
    nothing that an earlier batch wrote is changed. So a batch that a failure repeats starts from the same state and writes the same
    rows in place of its own; ``merged`` reads the newest batch of each partition.
    """
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")

    def batch(new: DataFrame, number: int) -> None:
        new = new.withColumn("part", part)
        touched = [r[0] for r in new.select("part").distinct().collect()]  # at most ``parts``
        if number:
            old = _newest(spark, schema, target, number - 1).where(F.col("part").isin(touched))
            new = new.unionByName(old.select(*new.columns))
        rest = [c for c in new.columns if c not in (*key, "part")]
        last = new.groupBy("part", *key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest), "part")
        last.write.mode("overwrite").partitionBy("part").parquet(f"{target}/batch={number}")

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _newest(spark: SparkSession, schema: T.StructType, target: str, upto: int | None = None) -> DataFrame:
    kind = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType())])
    rows = spark.read.schema(kind).parquet(target)
    rows = rows if upto is None else rows.where(F.col("batch") <= upto)
    newest = rows.groupBy("part").agg(F.max("batch").alias("batch"))  # a row for each key partition
    return rows.join(newest, ["part", "batch"], "left_semi")


def merged(spark: SparkSession, schema: T.StructType, target: str) -> DataFrame:
    """The last row of each key that ``merge_latest`` has kept under ``target``."""
    return _newest(spark, schema, target).drop("batch", "part")


def windowed(events: DataFrame, ts: str, by: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` in event-time windows; rows later than ``late`` are left out by the watermark."""
    t = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    w = F.window("__ts", size, slide) if slide else F.window("__ts", size)
    return t.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str) -> DataFrame:
    """(start, end, by, n): runs of events with no pause longer than ``gap``."""
    t = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return t.groupBy(F.session_window("__ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
