"""Phrase collocations by word-id suffix arrays.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. A shard
is a megabyte of text in one task: its words become ids, numpy prefix doubling sorts the suffixes of the id sequence
(a piece's end sorts before any word), and the intervals between places where the longest common prefix of neighbours
falls below n words are the shard's n-grams with their counts. Counts are merged over all shards by language and phrase.

Levels: words and pairs are counted first. Of longer phrases a shard only sends those whose parts, one word shorter, can
be frequent by the level before: a Bloom filter of the frequent phrases, of bounded size (``common.bloom_filter``), is
broadcast. A filter that fills up lets more through and changes no result, as counts are merged exactly.

A candidate's score is the lowest over its cuts of floor(scale * a * a / (l * r)), in decimals of 38 digits. A candidate
goes if a longer one that holds its words has ``share`` percent of its count or more.

Defined results: null and empty texts, and pieces without a word, give nothing; a null language is ``und``; repeated rows
count each; only ``text`` and ``lang`` are read, so other columns may have any name; an empty table gives no rows. Ties in
rank are settled by count, then by the phrase's bytes. A text longer than a shard is counted in slices that end with a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

#: Bytes of text in one suffix array: bounds a worker's memory (40 bytes a byte of text, up to 100 where words are short).
SHARD_BYTES = 1 << 20
#: Rows of counts in one batch.
ROWS = 1 << 15
#: Groups that each language's candidates are ranked in before the last ranking, at two levels.
SALTS = (256, 16)

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[list(b".,;:!?\n\x0b\x0c\r")] = 10
_NORMAL[9] = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
COUNTS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null is empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long normalised text in slices that end with a piece."""
    while len(data) > SHARD_BYTES:
        ends = np.flatnonzero(data[:SHARD_BYTES] == 10)
        cut = int(ends[-1]) if len(ends) else SHARD_BYTES + int(np.argmax(data[SHARD_BYTES:] == 10))
        if data[cut] != 10:  # one piece to the end
            break
        yield data[: cut + 1]
        data = data[cut + 1 :]
    yield data


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(normalised bytes, start of each text, language of each text) for a megabyte of text at a time."""
    data, langs, size = [], [], 0
    for batch in batches:
        offsets, raw = _bytes_of(batch.column("text"))
        raw = _NORMAL[raw]
        for lang, a, b in zip(batch.column("lang").to_pylist(), offsets, offsets[1:], strict=False):
            for part in _slices(raw[a:b]):
                if size and size + len(part) > SHARD_BYTES:
                    yield _packed(data, langs)
                    data, langs, size = [], [], 0
                data.append(part)
                langs.append("und" if lang is None else lang)
                size += len(part)
    if size:
        yield _packed(data, langs)


def _packed(data: list[np.ndarray], langs: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    starts = np.concatenate([[0], np.cumsum([len(x) for x in data])[:-1]]).astype(np.int64)
    return np.concatenate(data), starts, langs


class Words:
    """The words of a shard: ``ids`` into ``dictionary``, ``left`` words to the end of the piece, ``lang`` codes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, langs: list[str]):
        gap = (data == 32) | (data == 10)
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True
        first[-1] = True  # past the end
        begins = ~gap
        begins[1:] &= gap[:-1] | first[1:-1]
        at = np.flatnonzero(begins)
        ends = ~gap
        ends[:-1] &= gap[1:] | first[1:-1]
        offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - at)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]).dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.dictionary = coded.dictionary
        piece = np.cumsum((data == 10) | first[:-1])[at]
        last = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(at)) if len(at) else np.zeros(0, np.int64)
        self.left = np.repeat(last, np.diff(np.concatenate([[0], last]))) - np.arange(len(at))
        self.langs, codes = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.lang = codes[np.searchsorted(starts, at, side="right") - 1]

    def __len__(self) -> int:
        return len(self.ids)

    def hashes(self, n: int) -> np.ndarray:
        """A hash of the language and ``n`` words from each place; without meaning where fewer are left in the piece."""
        words = np.array([xxhash.xxh64_intdigest(w.as_buffer()) for w in self.dictionary], dtype=np.uint64)[self.ids]
        h = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs], dtype=np.uint64)[self.lang]
        for k in range(n):
            h = (h ^ (h >> np.uint64(31))) * _ODD
            h[: len(h) - k] ^= words[k:]
        h = (h ^ (h >> np.uint64(29))) * _ODD
        return h ^ (h >> np.uint64(32))

    def suffixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffix array by the first ``n`` words, common words of neighbours up to ``n``), by prefix doubling."""
        code = self.lang * len(self.dictionary) + self.ids
        h = 1
        order, rank = _ranked(code)
        while h < n:
            step = min(h, n - h)
            after = np.zeros(len(code), np.int64)
            after[:-step] = rank[step:] + 1
            after[self.left <= step] = 0
            order, rank = _ranked(rank * (len(code) + 1) + after)
            h += step
        a, b = order[:-1], order[1:]
        same, shared = np.ones(len(a), bool), np.zeros(len(a), np.int8)
        for k in range(n):
            same &= (self.left[a] > k) & (self.left[b] > k)
            same[same] = code[a[same] + k] == code[b[same] + k]
            shared += same
        return order, shared


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ascending order of ``key``, and each place's dense rank."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return order, rank


def _counter(sizes: list[int], known=None):
    """n-grams of ``sizes`` words with their counts in each shard; ``known``: a broadcast filter of phrases a word shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            w = Words(*shard)
            if not len(w):
                continue
            order, lcp = w.suffixes(max(sizes))
            if known is not None:
                may = common.bloom_has(known.value, w.hashes(max(sizes) - 1))
            else:
                per = np.bincount(w.lang, minlength=len(w.langs))
                yield pa.RecordBatch.from_arrays([pa.array(w.langs, pa.string()), pa.array(np.zeros(len(per)), pa.int32()), pa.array([""] * len(per)), pa.array(per, pa.int64())], schema=COUNTS)
            for n in sizes:
                edge = np.flatnonzero(np.concatenate([[True], lcp < n]))
                f, at = np.diff(np.append(edge, len(order))), order[edge]
                full = w.left[at] >= n
                if known is not None:
                    full &= may[at] & may[np.minimum(at + 1, len(w) - 1)]
                f, at = f[full], at[full]
                for k in range(0, len(at), ROWS):
                    some = at[k : k + ROWS]
                    parts = [w.dictionary.take(pa.array(w.ids[some + j])) for j in range(n)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ")) if n > 1 else parts[0]
                    langs = pa.array(w.langs, pa.string()).take(pa.array(w.lang[some]))
                    yield pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(some), n, np.int32)), phrase.view(pa.string()), pa.array(f[k : k + ROWS], pa.int64())], schema=COUNTS)

    return common.trimmed(run)


def _filter(frequent: DataFrame):
    """A Bloom filter of phrases of one length with their languages."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                offsets, data = _bytes_of(batch.column("phrase"))
                w = Words(data, offsets[:-1], batch.column("lang").to_pylist())
                n = int(w.left[0])
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes(n)[w.left == n].view(np.int64))], names=["h"])

    return common.bloom_filter(frequent.select("lang", "phrase").mapInArrow(hashed, "h long"))


def frequent_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10) -> DataFrame:
    """(lang, n, phrase, f): phrases of up to ``max_words`` words that occur ``min_count`` times or more; n 0 has all words' count."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))
    base = common.run_dir(spark, "phrases")

    def merged(counts: DataFrame, path: str) -> DataFrame:
        total = counts.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
        return common.stored(total.where((F.col("n") == 0) | (F.col("f") >= min_count)), path)

    kind = "lang string, n int, phrase string, f long"
    levels = [merged(texts.mapInArrow(_counter([n for n in (1, 2) if n <= max_words]), kind), f"{base}/2")]
    for n in range(3, max_words + 1):
        shorter = levels[-1].where(F.col("n") == n - 1)
        if shorter.isEmpty():
            break
        levels.append(merged(texts.mapInArrow(_counter([n], _filter(shorter)), kind), f"{base}/{n}"))
    return reduce(DataFrame.unionByName, levels)


def scored(frequent: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """(lang, phrase, n, a, l, r, score) of phrases of two words or more, by their lowest-scoring cut."""
    spark = frequent.sparkSession
    found = frequent.where("n >= 2").select("lang", "phrase", "n", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit(1).alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("part")),
    )
    base = common.run_dir(spark, "phrase-cuts")
    parts = common.stored(cuts.select("lang", "phrase", "n", "a", "k", F.explode(halves).alias("h")).select("lang", "phrase", "n", "a", "k", "h.side", "h.part"), f"{base}/parts")
    values = frequent.where("n >= 1").select("lang", F.col("phrase").alias("part"), "f")
    often = parts.groupBy("lang", "part").count().where(F.col("count") > F.lit(parts.count() / common.HEAVY))
    heavy = common.stored(values.join(F.broadcast(often), ["lang", "part"]).select("lang", "part", "f"), f"{base}/heavy")
    got = common.spread_join(parts, values, ["lang", "part"], heavy, ["phrase", "k", "side"]).repartition("lang", "phrase")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    both = got.groupBy("lang", "phrase", "n", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumn("a19", whole("a")).withColumn("l19", whole("l")).withColumn("r19", whole("r"))
    best = both.groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct(F.expr(f"CAST({scale} AS DECIMAL(7,0)) * a19 * a19 DIV (l19 * r19)").alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "n", "a", "b.l", "b.r", "b.score")


def without_parts(found: DataFrame, share: int = 50) -> DataFrame:
    """Candidates whose words no longer candidate of ``share`` percent of their count or more holds."""
    w = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inner = found.where("n >= 3").withColumn("w", w).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return found.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * CAST(longer AS DECIMAL(20,0)) < %d * CAST(a AS DECIMAL(20,0))" % share).drop("longer")


def first_ranks(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank; groups by a hash are ranked before, so that no task has a whole language."""
    from pyspark.sql.window import Window

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in SALTS:
        salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        found = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score."""
    frequent = frequent_phrases(docs, max_words, min_count)
    kept = common.stored(without_parts(scored(frequent), share), common.run_dir(docs.sparkSession, "phrases-kept"))
    words = frequent.where("n = 0").select("lang", F.col("f").alias("n"))
    return first_ranks(kept.drop("n"), top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
