"""Token counts with a digest cache.

Counts are kept in a Parquet table under ``(tokenizer_digest, content_digest)``. A request hashes each normalised text
once and writes the narrow ``(row, digest)`` table; its distinct digests are anti-joined to the stored counts. Only if
there are misses are texts grouped, those of the misses alone: few misses (``FEW_MISSES``) are looked up on the scan's
side, so the other texts are never shuffled. One text for each distinct miss is encoded and its count appended; the
answer is a join of the narrow table to the cache. A digest that many rows have is not joined by a shuffle.

Defined results: a null text counts as the empty text (0 bytes, the tokenizer's count for ""); repeated rows
and equal texts get equal counts and are encoded once; null ids are kept; an empty table gives no rows;
other columns are ignored, whatever their names. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common

CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_tokens long"
#: Digests of misses that are broadcast (32 bytes each); more are joined by a shuffle.
FEW_MISSES = 100_000
_loaded: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """The tokenizer's version: a digest of its file and the library that reads it."""
    kind = os.path.splitext(path)[1]
    if kind == ".model":
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def _counter(path: str):
    """Batch counter for a sentencepiece (.model) or tokenizers (.json) file, kept for the worker's life."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def _encode_misses(path: str, digest: str, group_bytes: int = 1 << 20):
    schema = pa.schema([("tokenizer_digest", pa.string()), ("content_digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            texts, counts, group, held = batch.column("t").to_pylist(), [], [], 0
            for t in texts:  # small groups: a batch of long texts has long lists of ids
                group.append(t)
                held += len(t)
                if held >= group_bytes:
                    counts += count(group)
                    group, held = [], 0
            counts += count(group) if group else []
            yield pa.record_batch([pa.array([digest] * len(texts), pa.string()), batch.column("d").cast(pa.binary()), pa.array(counts, pa.int64())], schema=schema)

    return run


class TokenCountCache:
    """Stored token counts of normalised texts, one tokenizer version each.

    ``normalise`` maps a text Column to the text that is hashed and encoded; it must keep counts, so the default
    only turns null into "".
    """

    def __init__(self, spark: SparkSession, tokenizer_path: str, cache_path: str, normalise=None):
        self.spark, self.path, self.cache_path = spark, tokenizer_path, cache_path
        self.digest = tokenizer_digest(tokenizer_path)
        self.normalise = normalise or (lambda c: F.coalesce(c.cast("string"), F.lit("")))

    def stored(self) -> DataFrame:
        try:
            kept = self.spark.read.schema(CACHE_SCHEMA).parquet(self.cache_path)
        except Exception as e:  # a cache that does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            kept = self.spark.createDataFrame([], CACHE_SCHEMA)
        return kept.where(F.col("tokenizer_digest") == self.digest).select("content_digest", "n_tokens")

    def digests(self, df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
        """``keep`` columns, n_bytes and the digest __d of each row's normalised text; written once, read often."""
        text = self.normalise(F.col(text_col))
        rows = df.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("__d"))
        return common.stored(rows, common.run_dir(self.spark, "text-digests"))

    def fill(self, df: DataFrame, text_col: str, rows: DataFrame | None = None) -> None:
        """Encode each distinct text that has no stored count, and append the counts."""
        common.prepare(self.spark)
        rows = self.digests(df, text_col, []) if rows is None else rows
        distinct, stored = rows.select("__d").distinct(), self.stored()
        missing = common.stored(distinct.join(stored, F.col("__d") == F.col("content_digest"), "left_anti"), common.run_dir(self.spark, "misses"))
        n = missing.count()
        if not n:
            return
        text = self.normalise(F.col(text_col))
        texts = df.select(text.alias("t"), F.unhex(F.sha2(text, 256)).alias("d"))
        if n <= FEW_MISSES:
            texts = texts.join(F.broadcast(missing), F.col("d") == F.col("__d"), "left_semi")
        misses = texts.groupBy("d").agg(F.first("t").alias("t"))
        if n > FEW_MISSES and not stored.isEmpty():
            misses = misses.join(missing, F.col("d") == F.col("__d"), "left_semi")
        misses.select("d", "t").mapInArrow(_encode_misses(self.path, self.digest), CACHE_SCHEMA).write.mode("append").parquet(self.cache_path)

    def counts(self, df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
        """``keep`` columns, ``n_bytes`` and ``n_tokens`` for each row of ``df``; fills the cache first."""
        rows = self.digests(df, text_col, keep)
        self.fill(df, text_col, rows)
        found = self.stored().groupBy(F.col("content_digest").alias("__d")).agg(F.max("n_tokens").alias("n_tokens"))
        heavy = rows.groupBy("__d").count().where(F.col("count") > F.lit(rows.count() // common.HEAVY)).select("__d")
        heavy = common.stored(found.join(heavy, "__d", "left_semi"), common.run_dir(self.spark, "heavy-texts"))
        return common.spread_join(rows, found, ["__d"], heavy, keep).select(*keep, "n_bytes", "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of each row of ``docs``.

    Without ``cache_path`` the cache is a new one in the shared folder, so nothing of an earlier run is used.
    """
    spark = docs.sparkSession
    cache = TokenCountCache(spark, tokenizer_path, cache_path or common.run_dir(spark, "token-counts"))
    out = cache.counts(docs.select("doc_id", "text"), "text", ["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
