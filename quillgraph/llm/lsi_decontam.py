"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words, and besides every word that at least one passage of the corpus in ``CONTEXT`` has: they
occur near the benchmark's words and so carry meaning between them. A passage has at most 32 words, so there are fewer than
``32 * CONTEXT`` of these. Only the benchmark's words count in a passage's
length, so a cosine doesn't depend on how rare other words are in a corpus of some size. An item of more than ``PIECE``
words is searched by pieces of about equal length, and verified as a whole. Passages are windows of each number of
blocks in ``WIDTHS``, one at each block of ``BLOCK`` words: narrow ones for close copies, wide ones for those with words put
between. Their TF-IDF vectors (document frequencies of all documents) are projected on the leading right singular vectors
of a matrix of passages: all of the corpus's, two blocks each, and the benchmark's items with the weight ``ITEM_WEIGHT``, so
that the latent space keeps what tells items apart. Nothing is sampled: texts are turned to numbers once, in a table that the
passes read. A benchmark of more than ``PIECES_IN_SPACE`` pieces has several spaces,
each of so many pieces and their words, so that no space has fewer dimensions than pieces; all are fitted and searched in
the same passes over the documents. The singular vectors come from a randomised SVD whose passes are
distributed: each partition adds up its part of A'(A X) in blocks of terms, blocks are summed on the executors, and only
the sum (terms x rank) reaches the driver for its QR. Up to ``PRODUCTS`` pairs of terms, A'A is added up once, over all passages
and for all spaces, in a table that the passes read; beyond that they read the passages' numbers.

A passage and an item whose latent cosine reaches ``MIN_COSINE`` are a candidate. It is checked on the words around the
passage, as many as ``REACH`` times the item's length on both sides: the longest common subsequence with the item, and the
answer, the item's rarest words, must be there. The answer check gives a bound that is exact: where the words that a
passage could be checked on, or more, don't have enough of an item's answer, no vector is made for that item.

Defined results: words are runs without ASCII white space, in lower case and without ASCII punctuation; null or empty
texts and items have no words and match nothing; an item of fewer than ``SHORT`` words must be there whole; repeated rows are each
reported; equal items are each reported; empty tables give no rows; null ids are reported as null; other columns are
ignored by ``leaks``. ``clean`` decides row by row, so rows that share an id, or have none, don't touch each other, and keeps
all columns. Texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

BLOCK = 16
#: Passages are windows of so many blocks.
WIDTHS = (2, 6)
MIN_COSINE = 0.35
MIN_COMMON = 0.7
MIN_ANSWER = 0.6
ANSWER_SHARE = 1 / 3
SHORT = 8
#: Words on either side of a passage that it is checked with, as a multiple of the item's length.
REACH = 3
#: A word besides the benchmark's is a term if one passage in so many has it.
CONTEXT = 1024
ITEM_WEIGHT = 20.0
#: Passages that the corpus weighs as, where it has more: the benchmark's part in the space doesn't shrink as the corpus grows.
CORPUS_WEIGHT = 1 << 15
RANK = 160
POWER_ROUNDS = 2
#: Pairs of terms whose products a task holds at once (four bytes each).
PRODUCTS = 1 << 25
#: Passages of a task that adds up products, where there are more tasks than cores.
PASSAGES_A_TASK = 1 << 19
#: The longest piece of an item that is compared with passages, in words.
PIECE = 4 * BLOCK
#: Pieces of items in one latent space: no more than its dimensions, or items lose their own direction.
PIECES_IN_SPACE = RANK
#: Items of one search; a larger benchmark is searched in so many passes over the documents.
ITEMS_AT_ONCE = 2000
_PUNCTUATION = bytes(i for i in range(128) if not chr(i).isalnum() and chr(i) not in " \t\n\r\x0b\x0c")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs without ASCII white space, less ASCII punctuation; what is empty then is no word."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


class Terms:
    """Numbers of words: from 1 the benchmark's, then those of the context; 0 stands for all other words."""

    def __init__(self, words: list[bytes], context: list[bytes] = ()):
        self.words, self.context, self.size, self.own = words, context, len(words) + len(context) + 1, len(words) + 1
        self.of = {w: i + 1 for i, w in enumerate([*words, *context])}

    def __getstate__(self):
        return self.words, self.context

    def __setstate__(self, state):
        self.__init__(*state)

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.of.get, words, repeat(0)), np.int32, len(words))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def pieces_of(item: np.ndarray) -> list[np.ndarray]:
    """The item in pieces of about equal length, of at most ``PIECE`` words."""
    return np.array_split(item, -(-len(item) // PIECE))


class Space:
    """One latent space: its words' vectors, and the unit vector of each of its pieces of items."""

    def __init__(self, local: np.ndarray, idf: np.ndarray, basis: np.ndarray, items: list[tuple[int, np.ndarray]]):
        self.local = local  # numbers of the words here, 0 where they are in none of the items
        self.vectors = (idf[:, None] * basis).astype(np.float32)
        self.vectors[0] = 0
        self.of = np.array([i for i, _ in items], dtype=np.int64)
        q = np.array([self.vectors[local[t]].sum(axis=0) for _, t in items], dtype=np.float32).reshape(len(items), basis.shape[1])
        self.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).T.copy()


class Index:
    """The benchmark: term weights, items, their answers, and the latent spaces that they are searched in."""

    def __init__(self, terms: Terms, idf: np.ndarray, items: list[tuple[object, np.ndarray]], spaces: list[Space], answer_share: float = MIN_ANSWER):
        self.terms, self.idf, self.items, self.spaces, self.answer_share = terms, idf.astype(np.float32), items, spaces, answer_share
        self.square = self.idf.astype(np.float64) ** 2
        self.square[0] = self.square[terms.own :] = 0
        self.answers = [answer_terms(t, idf) for _, t in items]
        # the items of each answer term, and how many of its answer terms an item needs
        pairs = np.array(sorted((t, i) for i, a in enumerate(self.answers) for t in a), dtype=np.int64).reshape(-1, 2)
        self.answer_of, self.answer_n = pairs[:, 1], np.bincount(pairs[:, 0], minlength=terms.size)
        self.answer_at = np.cumsum(self.answer_n) - self.answer_n
        self.need = np.array([math.ceil(answer_share * len(a) - 1e-9) for a in self.answers], dtype=np.int64)
        # a passage's span holds all that it may be checked on: the words from ``back`` before it
        longest = max((len(t) for _, t in items), default=0)
        self.back = REACH * longest
        self.step = 2 * self.back + max(WIDTHS) * BLOCK

    def hopeful(self, terms: np.ndarray, nth: np.ndarray, doc: np.ndarray, spans: int) -> tuple[np.ndarray, np.ndarray]:
        """(span, item) of the spans that have enough of an item's answer; spans are numbered from document * ``spans``.

        Span ``k`` of a document has its words from ``k * step`` to ``(k + 2) * step``.
        """
        some = np.flatnonzero(self.answer_n[terms])
        t, k = terms[some].astype(np.int64), nth[some] // self.step
        both = np.concatenate([(doc[some] * spans + k) * self.terms.size + t, ((doc[some] * spans + k - 1) * self.terms.size + t)[k > 0]])
        both = np.unique(both)
        span, t = both // self.terms.size, both % self.terms.size
        n = self.answer_n[t]
        pair, have = np.unique(np.repeat(span, n) * len(self.items) + self.answer_of[ragged(self.answer_at[t], n)], return_counts=True)
        pair = pair[have >= self.need[pair % len(self.items)]]
        free = np.flatnonzero(self.need == 0)
        if len(free):  # no answer asked for: every span
            every = np.unique(np.concatenate([doc * spans + nth // self.step]))
            pair = np.unique(np.concatenate([pair, (every[:, None] * len(self.items) + free).ravel()]))
        return pair // len(self.items), pair % len(self.items)

    def candidates(self, docs: list[np.ndarray], least: float) -> dict[tuple[int, int], list[tuple[int, float]]]:
        """(document, item) -> (first word, cosine) of each passage whose latent cosine is at least ``least``."""
        out: dict[tuple[int, int], list[tuple[int, float]]] = {}
        size = np.array([len(d) for d in docs], dtype=np.int64)
        if not size.sum():
            return out
        terms, base = np.concatenate(docs), np.cumsum(size) - size
        doc = np.repeat(np.arange(len(docs)), size)
        spans = int(size.max()) // self.step + 1
        span, item = self.hopeful(terms, np.arange(len(terms)) - base[doc], doc, spans)
        if not len(span):
            return out
        # blocks of the documents that have a hopeful span
        use = np.unique(span // spans)
        count = -(-size[use] // BLOCK)
        of, last = np.repeat(use, count), np.repeat(np.cumsum(count), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = base[of] + nth * BLOCK
        long = np.minimum(BLOCK, base[of] + size[of] - at)
        norm2 = np.concatenate([[0.0], np.cumsum(np.add.reduceat(self.square[terms[ragged(at, long)]], np.cumsum(long) - long))])
        allowed = np.unique(span * len(self.items) + item)
        for width in WIDTHS:
            # a window at each block; none that only ends with the document, but for its first
            first = np.flatnonzero((nth == 0) | (np.arange(len(of)) + width <= last))
            end = np.minimum(first + width, last[first])
            here = of[first] * spans + np.maximum(nth[first] * BLOCK - self.back, 0) // self.step
            norm = np.sqrt(norm2[end] - norm2[first])
            for space in self.spaces:
                mine = np.isin(item, space.of)
                chosen = np.flatnonzero(np.isin(here, span[mine]) & (norm > 0))
                for a in range(0, len(chosen), 2048):
                    w = chosen[a : a + 2048]
                    lo = at[first[w]]
                    n = at[end[w] - 1] + long[end[w] - 1] - lo
                    vec = np.add.reduceat(space.vectors[space.local[terms[ragged(lo, n)]]], np.cumsum(n) - n, axis=0)
                    # words that repeat make a vector longer than its squares add up to
                    cos = np.minimum((vec @ space.queries) / norm[w][:, None], 1)
                    row, piece = np.nonzero(cos >= least)
                    i = space.of[piece]
                    pair = here[w[row]] * len(self.items) + i
                    fit = np.flatnonzero(allowed[np.minimum(np.searchsorted(allowed, pair), len(allowed) - 1)] == pair)
                    for r, p, k in zip(row[fit].tolist(), piece[fit].tolist(), i[fit].tolist()):
                        d = int(of[first[w[r]]])
                        out.setdefault((d, k), []).append((int(lo[r] - base[d]), float(cos[r, p])))
        return out

    def found(self, docs: list[np.ndarray], least: float, common_share: float) -> Iterator[tuple]:
        """(document, item, cosine, lcs, answer share, from word, to word) of each item that a document holds."""
        for (d, i), passages in sorted(self.candidates(docs, least).items()):
            item, answer, best = self.items[i][1], self.answers[i], None
            n = len(item)
            for at, cos in sorted(passages, key=lambda p: (-p[1], p[0])):
                lo, hi = max(0, at - REACH * n), min(len(docs[d]), at + max(WIDTHS) * BLOCK + REACH * n)
                words = docs[d][lo:hi]
                here = set(words.tolist())
                share = sum(t in here for t in answer) / len(answer)
                if share < self.answer_share:
                    continue
                lcs = common_subsequence(item, words)
                if lcs >= (n if n < SHORT else common_share * n) and (best is None or lcs > best[1]):
                    best = (cos, lcs, share, lo, hi)
                    if lcs == n:
                        break
            if best:
                yield (d, i, *best)


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item; term 0 matches nothing."""
    n, masks = len(item), {}
    for k, t in enumerate(item.tolist()):
        if t:
            masks[t] = masks.get(t, 0) | 1 << k
    full = (1 << n) - 1
    row = full
    for t in words.tolist():
        m = masks.get(t)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def answer_terms(item: np.ndarray, idf: np.ndarray) -> set[int]:
    """The rarest of an item's distinct terms."""
    distinct = sorted(set(item.tolist()), key=lambda t: (-idf[t], t))
    return set(distinct[: max(1, math.ceil(len(distinct) * ANSWER_SHARE))])


def _search(index: Index, least: float, common_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [index.terms.numbers(t) for t in batch.column("text").to_pylist()]
            out = [(d, index.items[i][0], *rest, len(index.items[i][1])) for d, i, *rest in index.found(docs, least, common_share)]
            cols = list(zip(*out)) or [[]] * 8
            kinds = [pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
            names = ["cosine", "lcs", "answer", "from_word", "to_word", "item_words"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *(pa.array(c, k) for c, k in zip(cols[2:], kinds))], names=["doc_id", "item", *names])

    return common.trimmed(run)


def _without(index: Index, least: float, common_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist()
            keep = np.ones(len(batch), dtype=bool)
            keep[[d for d, *_ in index.found([index.terms.numbers(t) for t in texts], least, common_share)]] = False
            yield batch.filter(pa.array(keep))

    return common.trimmed(run)


def _passages(words: list[bytes]) -> list[list[bytes]]:
    """The whole text in stretches of two blocks."""
    return [words[k : k + 2 * BLOCK] for k in range(0, len(words), 2 * BLOCK)]


def _context(terms: Terms, most: int = 1 << 17):
    """Other words with the number of passages that have them; the empty word stands for all passages."""

    def counts(count: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                for p in _passages(words_of(t)):
                    count[b""] += 1
                    count.update(set(p).difference(terms.of))
                    if len(count) > most:
                        yield counts(count)
                        count = Counter()
        yield counts(count)

    return common.trimmed(run)


def _numbers(terms: Terms):
    """A row for each document: how many terms each of its passages has, and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, numbers = [], []
            for text in batch.column("text").to_pylist():
                d = terms.numbers(text)
                some = np.flatnonzero(d)
                sizes.append(np.bincount(some // (2 * BLOCK), minlength=-(-len(d) // (2 * BLOCK))).astype("<i4").tobytes())
                numbers.append(d[some].astype("<i4").tobytes())
            yield pa.record_batch([pa.array(sizes, pa.binary()), pa.array(numbers, pa.binary())], names=["sizes", "terms"])

    return common.trimmed(run)


def _held(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<i4") for x in column.to_pylist()]


def _frequencies(terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(terms.size, dtype=np.int64)
        for batch in batches:
            docs = _held(batch.column("terms"))
            doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            all_ = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
            count += np.bincount(np.unique(doc * terms.size + all_) % terms.size, minlength=terms.size)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["term", "n"])

    return common.trimmed(run)


def _triangle(terms: int) -> np.ndarray:
    """Where term i's row of an upper triangle begins, less i: the pair (i, j), i <= j, is at place i of this, plus j."""
    i = np.arange(terms + 1, dtype=np.int64)
    return i * terms - i * (i + 1) // 2


def _products(idf: np.ndarray, rows: int = 32):
    """The partition's part of A'A, its upper triangle in blocks of ``rows`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _triangle(len(idf))
        total = np.zeros(len(idf) * (len(idf) + 1) // 2, dtype=np.float32)
        for batch in batches:
            sizes, terms = (np.concatenate(_held(batch.column(c)) or [np.zeros(0, "<i4")]) for c in ("sizes", "terms"))
            sizes = sizes[sizes > 0]
            ends = np.cumsum(sizes)
            for a in range(0, len(sizes), 1024):
                size = sizes[a : a + 1024]
                every, rows_of = terms[ends[a] - size[0] : ends[a + len(size) - 1]], np.repeat(np.arange(len(size)), size)
                # each passage's terms once, in order: a term's pairs are with itself and those after it
                pair, count = np.unique(rows_of * len(idf) + every, return_counts=True)
                of, t = pair // len(idf), pair % len(idf)
                w = (count * idf[t] / np.sqrt(np.bincount(rows_of, weights=idf[every] ** 2))[of]).astype(np.float32)
                after = np.cumsum(np.bincount(of, minlength=len(size)))[of] - np.arange(len(of))
                left, right = np.repeat(np.arange(len(of)), after), ragged(np.arange(len(of)), after)
                np.add.at(total, at[t[left]] + t[right], w[left] * w[right])
        for b in range(0, len(idf), rows):
            part = total[at[b] + b : at[min(b + rows, len(idf))] + min(b + rows, len(idf))]
            if part.any():
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([part.astype("<f4").tobytes()], pa.binary())], names=["block", "products"])

    return common.trimmed(run)


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, dtype="<f4").astype("<f8") for b in table.column("products").to_pylist())
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "products": pa.array([total.tobytes()], pa.binary())})


def _multiplied(bases: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int = 256):
    """The same as ``_sketch`` from blocks of A'A."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # over all terms; those that a space lacks have no vector
        xs = [np.where(local[:, None] > 0, x[local], 0).astype(np.float32) for local, _, x in bases]
        zs = [np.zeros(x.shape) for x in xs]
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("products").to_pylist()):
                values, size = np.frombuffer(data, dtype="<f8"), len(xs[0]) - b
                n = next(n for n in range(1, size + 1) if n * size - n * (n - 1) // 2 == len(values))
                part = np.zeros((n, size), dtype=np.float32)
                part[np.triu_indices(n, 0, size)] = values
                rest = part.copy()
                rest[np.arange(n), np.arange(n)] = 0
                for z, x in zip(zs, xs):
                    z[b : b + n] += part @ x[b:]
                    z[b:] += rest.T @ x[b : b + n]
        yield _blocks([_of_space(z, local, x) for z, (local, _, x) in zip(zs, bases)], rows)

    return common.trimmed(run)


def _of_space(z: np.ndarray, local: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of all terms as those of a space's own numbers."""
    out = np.zeros(x.shape)
    out[local[local > 0]] = z[local > 0]
    return out


def _blocks(zs: list[np.ndarray], rows: int) -> pa.RecordBatch:
    at, data = [], []
    for k, z in enumerate(zs):
        z[0] = 0
        for b in range(0, len(z), rows):
            at.append((k, b))
            data.append(z[b : b + rows].astype("<f8").tobytes())
    return pa.record_batch([pa.array([k for k, _ in at], pa.int32()), pa.array([b for _, b in at], pa.int32()), pa.array(data, pa.binary())], names=["space", "block", "z"])


def _sketch(idf: np.ndarray, bases: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int = 256):
    """The partition's part of A'(A x) of each space (local numbers, idf, x), as blocks of ``rows`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zs = [np.zeros(x.shape) for _, _, x in bases]
        xs = [x.astype(np.float32) for _, _, x in bases]
        for x in xs:
            x[0] = 0  # terms that a space lacks
        for batch in batches:
            sizes, terms = (np.concatenate(_held(batch.column(c)) or [np.zeros(0, "<i4")]) for c in ("sizes", "terms"))
            sizes = sizes[sizes > 0]
            ends = np.cumsum(sizes)
            for a in range(0, len(sizes), 128):
                size = sizes[a : a + 128]
                every, rows_of = terms[ends[a] - size[0] : ends[a + len(size) - 1]], np.repeat(np.arange(len(size)), size)
                # the passages as a small dense matrix of the terms that they have
                here, t = np.unique(every, return_inverse=True)
                part = np.bincount(rows_of * len(here) + t, weights=idf[every], minlength=len(size) * len(here)).reshape(len(size), len(here))
                part /= np.sqrt(np.bincount(rows_of, weights=idf[every] ** 2))[:, None]
                part = part.astype(np.float32)
                for z, x, (local, _, _) in zip(zs, xs, bases):
                    mine = local[here]
                    z[mine] += part.T @ (part @ x[mine])
        yield _blocks(zs, rows)

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, dtype="<f8") for b in table.column("z").to_pylist())
    at = {c: pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("space", "block")}
    return pa.table(at | {"z": pa.array([total.tobytes()], pa.binary())})


def latent_space(docs: DataFrame, items: list[tuple[object, str | None]], rank: int = RANK, seed: int = 7, answer_share: float = MIN_ANSWER) -> Index | None:
    """Fit the spaces: document frequencies of all documents, singular vectors by a distributed randomised SVD."""
    words = sorted({w for _, text in items for w in words_of(text)})
    n = docs.count()
    if not words or not n:
        return None
    spark = docs.sparkSession
    near = common.stored(docs.select("text").mapInArrow(_context(Terms(words)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), common.run_dir(spark, "latent-words"))
    passages = near.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    near = near.where((F.length("word") > 0) & (F.col("n") > 1) & (F.col("n") * CONTEXT >= passages)).select("word").orderBy("word")
    terms = Terms(words, [bytes(r["word"]) for r in near.collect()])
    numbered = [(name, t) for name, text in items if len(t := terms.numbers(text))]
    numbers = common.stored(docs.select("text").mapInArrow(_numbers(terms), "sizes binary, terms binary"), common.run_dir(spark, "latent-numbers"))
    got = numbers.select("terms").mapInArrow(_frequencies(terms), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each term
    df = np.zeros(terms.size)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    df[0] = 0
    idf = np.log((n + 1) / (df + 1)) + 1
    idf[0] = 0
    every = [(i, piece) for i, (_, t) in enumerate(numbered) for piece in pieces_of(t)]
    groups = [every[k : k + PIECES_IN_SPACE] for k in range(0, len(every), PIECES_IN_SPACE)]
    fits, rng = [], np.random.default_rng(seed)
    for group in groups:
        used = np.unique(np.concatenate([*(t for _, t in group), np.arange(terms.own, terms.size)]))
        local = np.zeros(terms.size, dtype=np.int32)
        local[used] = np.arange(1, len(used) + 1)
        weight = np.concatenate([[0.0], idf[used]])
        a = np.zeros((len(group), len(weight)), dtype=np.float32)
        for k, (_, t) in enumerate(group):
            np.add.at(a[k], local[t], idf[t])
        a *= ITEM_WEIGHT / np.linalg.norm(a, axis=1, keepdims=True)
        fits.append([local, weight, rng.standard_normal((len(weight), min(min(rank, len(group)) + 16, len(weight)))), a])
    held, step = numbers, lambda bases: _sketch(idf, bases)
    if terms.size * (terms.size + 1) // 2 <= PRODUCTS:
        some = numbers.coalesce(max(spark.sparkContext.defaultParallelism, -(-passages // PASSAGES_A_TASK)))
        some = some.mapInArrow(_products(idf), "block int, products binary").groupBy("block").applyInArrow(_added, "block int, products binary")
        held, step = common.stored(some, common.run_dir(spark, "latent-products")), _multiplied
    for _ in range(POWER_ROUNDS + 1):
        parts = held.mapInArrow(step([(local, weight, x) for local, weight, x, _ in fits]), "space int, block int, z binary").groupBy("space", "block").applyInArrow(_summed, "space int, block int, z binary").toArrow()
        zs = [a.T @ (a @ x) for _, _, x, a in fits]
        for k, block, data in zip(*(parts.column(c).to_pylist() for c in ("space", "block", "z"))):
            part = np.frombuffer(data, dtype="<f8").reshape(-1, zs[k].shape[1])
            zs[k][block : block + len(part)] += part * min(1, CORPUS_WEIGHT / max(passages, 1))
        for fit, z in zip(fits, zs):
            fit[2], _ = np.linalg.qr(z)
    return Index(terms, idf, numbered, spaces=[Space(local, weight, x, group) for (local, weight, x, _), group in zip(fits, groups)], answer_share=answer_share)


def _indexes(rows: DataFrame, benchmark: DataFrame, rank: int, answer_share: float) -> Iterator[Index]:
    """An index of each block of about ``ITEMS_AT_ONCE`` items: what the driver holds at once doesn't grow with them."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    blocks = -(-items.count() // ITEMS_AT_ONCE)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        held = [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").toArrow().to_pylist()]
        index = latent_space(rows, held, rank, answer_share=answer_share)
        if index is not None:
            yield index


def _rows(docs: DataFrame) -> DataFrame:
    common.prepare(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, least_cosine: float = MIN_COSINE, common_share: float = MIN_COMMON, answer_share: float = MIN_ANSWER, rank: int = RANK
) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, cosine, lcs, item_words, answer, from_word, to_word."""
    rows = _rows(docs)
    kind, of = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item long, cosine double, lcs int, answer double, from_word long, to_word long, item_words int"
    out = docs.sparkSession.createDataFrame([], schema)
    for k, index in enumerate(_indexes(rows, benchmark, rank, answer_share)):
        found = rows.mapInArrow(_search(index, least_cosine, common_share), schema)
        out = out.unionByName(found) if k else found
    return out.select("doc_id", F.col("item").cast(of).alias("item_id"), F.round("cosine", 4).alias("cosine"), "lcs", "item_words", F.round("answer", 4).alias("answer"), "from_word", "to_word")


def clean(docs: DataFrame, benchmark: DataFrame, least_cosine: float = MIN_COSINE, common_share: float = MIN_COMMON, answer_share: float = MIN_ANSWER, rank: int = RANK) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item: each row is judged by its own text, nothing is shuffled."""
    rows, out = _rows(docs), docs
    for index in _indexes(rows, benchmark, rank, answer_share):
        out = out.mapInArrow(_without(index, least_cosine, common_share), docs.schema)
    return out
