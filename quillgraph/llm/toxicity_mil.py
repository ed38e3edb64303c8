"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct words, each of which counts
with its own weight and those of its first 4 and 5 letters (so forms that the sample never had count too); a document's
score is the noisy-or of its sentences, 1 - prod(1 - p). Only documents have labels: the weights are fitted to them
through the noisy-or (proximal Adam with an L1 penalty), and a fitted model then points at the sentences that make a
document toxic. Features are words and prefixes that toxic documents of the sample have at least ``LIFT`` times as often.

The training sample is bounded: at most ``SAMPLE_DOCS`` labelled documents, those with the smallest hash of their id, with
their whole texts. Executors count its features and turn its texts into rows of feature numbers; the driver gets those
numbers, never a text, and only takes the steps of the fit.

A document that reaches ``threshold`` (so that its label is 1) has its strongest sentence located.

Defined results: a null or empty text, or one without words, has one empty sentence and so the model's base score;
a document that has several labels counts as toxic if one of them is; null labels are left out; without any label of
both kinds all scores are the rate of toxic labels; repeated rows get equal scores; null ids are kept and their labels
never join; whole texts are scored; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

#: The bound of the training sample, in documents.
SAMPLE_DOCS = 12_000
MIN_DOCS = 5  # a feature is in at least so many documents of the sample
LIFT = 3.0
PREFIXES = (4, 5)
THRESHOLD = 0.3

#: Sentence ends become line ends, other punctuation and digits become spaces.
_TABLE = {i: " " for i in range(0x250) if not chr(i).isalpha() and chr(i) not in "'’"} | {ord(c): "\n" for c in ".!?\n\r"}


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence; a text without words has one empty sentence."""
    out = [w for line in (text or "").lower().translate(_TABLE).split("\n") if (w := line.split())]
    return out or [[]]


_SPAN = re.compile(r"[^.!?\n\r]+")


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence that has a word, in the order of ``sentences``."""
    return [(m.start(), m.end()) for m in _SPAN.finditer(text) if m[0].lower().translate(_TABLE).split()] or [(0, 0)]


def features(word: str) -> list[str]:
    """A word and its prefixes (marked, so that they differ from words)."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class Model:
    """Weights of features, and the base score of a sentence (both as log odds)."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.words = {k: v for k, v in weights.items() if not k.endswith("*")}
        self.prefixes = [(n, {k[:-1]: v for k, v in weights.items() if k.endswith("*") and len(k) == n + 1}) for n in PREFIXES]
        self.stems = {k[: min(PREFIXES)] for k in weights}

    def weight(self, word: str) -> float:
        return self.words.get(word, 0.0) + sum(p.get(word[:n], 0.0) for n, p in self.prefixes if len(word) >= n)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document score, its strongest sentence's place, that sentence's score) of each text."""
        n, stems, weight, doc, total = min(PREFIXES), self.stems, self.weight, [], []
        for k, t in enumerate(texts):
            for words in sentences(t):
                doc.append(k)
                # most words begin like no feature
                known = {w for w in words if w[:n] in stems}
                total.append(sum(map(weight, sorted(known))) if known else 0.0)
        doc, z = np.array(doc, dtype=np.int64), np.array(total) + self.bias
        softplus = np.logaddexp(0, z)  # -log(1 - p)
        score = -np.expm1(-np.bincount(doc, weights=softplus, minlength=len(texts)))
        start = np.searchsorted(doc, np.arange(len(texts)))
        order = np.lexsort((-z, doc))
        best = order[start] if len(order) else order
        return np.clip(score, 0, 1), best - start, 1 / (1 + np.exp(-z[best]))


def counted(rows: Iterable[tuple[str | None, int]]) -> tuple[Counter, Counter]:
    """(documents, toxic documents) that have each feature."""
    seen, bad = Counter(), Counter()
    for t, label in rows:
        own = {f for words in sentences(t) for w in words for f in features(w)}
        seen.update(own)
        if label:
            bad.update(own)
    return seen, bad


def least_share(toxic: float) -> float:
    """The share of toxic documents from which a feature is taken, given their share in all."""
    return min(LIFT * toxic, 0.5 + toxic / 2)


def bag(text: str | None, index: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """A text's sentences without a feature (a number: all have the base score), how many features each of the others has,
    and those features' numbers, sentence after sentence."""
    plain, sizes, columns = 0, [], []
    for words in sentences(text):
        own = sorted(i for w in set(words) for f in features(w) if (i := index.get(f)) is not None)
        if own:
            sizes.append(len(own))
            columns += own
        else:
            plain += 1
    return plain, sizes, columns


def solve(index: dict[str, int], y: np.ndarray, bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 200, rate: float = 0.2, l1: float = 1e-4) -> Model:
    """Fit weights to documents' labels ``y`` and their bags through the noisy-or."""
    toxic, plain = float(y.mean()), np.array([p for p, _, _ in bags], dtype=float)
    size = np.concatenate([np.asarray(s, dtype=np.int64) for _, s, _ in bags])
    col = np.concatenate([np.asarray(c, dtype=np.int64) for _, _, c in bags])
    doc, at = np.repeat(np.arange(len(bags)), [len(s) for _, s, _ in bags]), np.repeat(np.arange(len(size)), size)
    w, b = np.zeros(len(index)), float(np.log(toxic * len(y) / (len(doc) + plain.sum())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, epochs + 1):
        z = np.bincount(at, weights=w[col], minlength=len(doc)) + b
        p, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, b)
        share = np.exp(-total)  # probability that no sentence is toxic
        pull = np.where(y > 0, -share / np.maximum(1 - share, 1e-9), 1.0) / len(y)
        g = pull[doc] * p
        gw, gb = np.bincount(col, weights=g[at], minlength=len(w)), g.sum() + (pull * plain).sum() * base
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        now = rate / (1 + 3 * step / epochs)
        size_ = now / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        w = w - size_ * m / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(np.abs(w) - size_ * l1, 0)
        b -= now * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-5)
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, float(b))


def constant(toxic: float) -> Model:
    """The model where there is nothing to tell apart: every sentence has the rate of toxic labels."""
    p = min(max(toxic, 1e-6), 1 - 1e-6)
    return Model({}, float(np.log(p / (1 - p))))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, text, toxic of the labelled documents to learn from; one text for each id, also where rows repeat it."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return common.stored(rows.repartition(16), common.run_dir(docs.sparkSession, "toxicity-sample"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, bad = Counter(), Counter()
    for batch in batches:
        s, b = counted(zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()))
        seen.update(s)
        bad.update(b)
    yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[f] for f in seen], pa.int64())], names=["feature", "n", "bad"])


def _bags(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(bag(t, index) for t in batch.column("text").to_pylist()))) or [[], [], []]
            new = [pa.array(x, t) for x, t in zip(got, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *new], names=["doc_id", "toxic", "plain", "sizes", "columns"])

    return run


def fit(rows: DataFrame) -> Model:
    """Fit to a bounded sample of rows (doc_id, text, toxic)."""
    common.prepare(rows.sparkSession)
    n, bad = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    toxic = (bad or 0) / n if n else 0.0
    if not 0 < toxic < 1:
        return constant(toxic)
    count = rows.mapInArrow(_count, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    taken = count.where((F.col("n") >= MIN_DOCS) & ((F.col("bad") + 0.5) / (F.col("n") + 1) >= least_share(toxic)))
    # words that several documents of the sample share: bounded as the sample is
    index = {r["feature"]: i for i, r in enumerate(taken.orderBy(F.desc("bad"), "feature").collect())}
    kind = rows.schema["doc_id"].dataType.simpleString()
    bags = rows.mapInArrow(_bags(index), f"doc_id {kind}, toxic int, plain long, sizes array<int>, columns array<int>").orderBy("doc_id").toArrow()
    arrays = lambda name: [x.values.to_numpy() for x in bags.column(name)]
    return solve(index, bags.column("toxic").to_numpy().astype(float), list(zip(bags.column("plain").to_pylist(), arrays("sizes"), arrays("columns"))))


def _apply(m: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "score", "worst_sentence", "worst_score", "worst_start", "worst_end"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score, place, worst = m.score(texts)
            # spans are worked out for documents that count as toxic; the others have none to show
            at = [spans(t)[k] if t and s >= threshold else (None, None) for t, k, s in zip(texts, place.tolist(), score.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(place, pa.int64()), pa.array(worst), pa.array([a for a, _ in at], pa.int64()), pa.array([b for _, b in at], pa.int64())], names=names
            )

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, and the strongest sentence: its place, score, and where it starts and ends if the score reaches ``threshold``."""
    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _apply(model, threshold), f"doc_id {kind}, score double, worst_sentence long, worst_score double, worst_start long, worst_end long"
    )


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the strongest sentence; learns from labels of the folds not held out."""
    fold = common.crc_mod("doc_id", folds)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = fit(sample(rows, labels.select("doc_id", "toxic"), fold != held))
    return score(rows, model, threshold).select(
        "doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_sentence", "worst_score", "worst_start", "worst_end"
    )
