"""Shared helpers: session set-up, run folders in the shared checkpoint folder, and column access."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes in one Arrow batch handed to Python; bound a worker's memory when texts are long.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: A key is heavy if more than one row in so many has it; there are fewer heavy keys than this.
HEAVY = 1000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release() -> None:
    """Give memory that Python has freed back to the system: a worker lives on between tasks, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run):
    """A batch function after which freed memory is given back."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root else f"file://{os.path.abspath(root)}"


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own for one run of an operator, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts the lineage, and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], heavy: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` left-joined to ``values``, which has at most one row for each of ``keys``.

    ``heavy`` has the rows of ``values`` whose keys are heavy: fewer than ``HEAVY``, so they are broadcast, and the rows that
    they answer are dealt out by a hash of ``by`` and not by their key. Both tables should be written ones, as they are read twice.
    """
    own = [c for c in values.columns if c not in keys]
    few = heavy.select(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)), F.struct(*own).alias("__hv"))
    rest = values.select(*(F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)), F.struct(*own).alias("__rv"), F.xxhash64(*keys).alias("__rh"))
    known = F.col("__hv").isNotNull()
    marked = rows.join(F.broadcast(few), reduce(and_, (F.col(k) == F.col(f"__h{i}") for i, k in enumerate(keys))), "left")
    # the hash is a join key as well: for answered rows it is one of their own, and their key is null
    marked = marked.select(
        *(F.col(f"`{c}`") for c in rows.columns), "__hv", F.when(known, F.xxhash64(*by)).otherwise(F.xxhash64(*keys)).alias("__lh"),
        *(F.when(~known, F.col(k)).alias(f"__k{i}") for i, k in enumerate(keys)),
    )
    on = reduce(and_, (F.col(f"__k{i}") == F.col(f"__r{i}") for i in range(len(keys))), F.col("__lh") == F.col("__rh"))
    return marked.join(rest, on, "left").select(*(F.col(f"`{c}`") for c in rows.columns), *(F.coalesce(F.col(f"__hv.{c}"), F.col(f"__rv.{c}")).alias(c) for c in own))


#: 64-bit words of the largest Bloom filter (16 MB), and values for each of its words.
MOST_BLOOM, BLOOM_LOAD = 1 << 21, 4


def _bloom_mask(h: np.ndarray) -> np.ndarray:
    """Three bits of a 64-bit word."""
    one, low = np.uint64(1), np.uint64(63)
    return (one << (h & low)) | (one << ((h >> np.uint64(6)) & low)) | (one << ((h >> np.uint64(12)) & low))


def _bloom_word(h: np.ndarray, size: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(size)).astype(np.int64)


def bloom_has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; never False for one that is."""
    mask = _bloom_mask(h)
    return (bits[_bloom_word(h, len(bits))] & mask) == mask


def bloom_filter(hashes: DataFrame):
    """A broadcast Bloom filter of a column of 64-bit hashes, as a numpy array of at most ``MOST_BLOOM`` words.

    Bits are put together on the executors. A filter of more values than it has room for lets more through, so it may only keep
    out what an exact step would drop later.
    """
    size, n = 1 << 10, hashes.count()
    while size < MOST_BLOOM and size * BLOOM_LOAD < n:
        size *= 2

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_bloom_word(h, size)), pa.array(_bloom_mask(h).view(np.int64))], names=["word", "bits"])

    rows = hashes.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null values count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(n))
