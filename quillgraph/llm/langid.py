"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text becomes a suffix automaton: at most ``SAMPLE_DOCS`` documents, and of
their whole texts pieces from all over, ``REFERENCE_CHARS`` characters together. A text is parsed greedily against each:
a phrase is the longest match from where the last one ended; a character that the reference lacks ends a phrase, and the
next one starts after it. A language that explains a text well needs few phrases;
phrases are normalised to bits a character, ``phrases * log2(reference length) / characters``, and the lowest wins.

The greedy parse is a walk through the automaton that starts again at its root where no transition goes on, so it is one
table look-up for each character. Texts are cut into blocks (a phrase ends with its block) and all blocks of a batch
walk in step.

Letters are lower-cased, runs of other characters are one space. Defined results: a null text, or one without a letter,
is ``und`` with score 0; texts are parsed whole; ties go to the first language by name; repeated rows get equal
results; null ids are kept; without any learned language all are ``und``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import common

#: The bound of the training sample: documents of a language, and characters of its reference.
SAMPLE_DOCS = 128
REFERENCE_CHARS = 24_576
PIECE = 512
#: More values of lang than this are an error: their automata would take more than half a gigabyte of a worker.
MOST_LANGS = 1_000
BLOCK = 1024
#: Letters of a language up to which its automaton is a full table; with more, its transitions are looked up by key.
DENSE = 96
#: Languages up to which automata are full tables (about 4 MB each), built in every worker. With more, all are keys (about half a
#: megabyte each, so some hundred languages fit a worker), built once by Spark's tasks and shipped.
DENSE_LANGS = 16
SHARPNESS = 8.0


def sample(docs: DataFrame, learn: Column, per_lang: int = SAMPLE_DOCS, most_chars: int = REFERENCE_CHARS, piece: int = PIECE) -> dict[str, list[str]]:
    """Texts to learn from: of each non-null lang the ``per_lang`` distinct rows with the smallest hash of id and text.

    A longer text is as many pieces of it, spread evenly, as a reference can hold.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"), "text")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGS + 1).collect()  # a row for each language
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values: these are no languages")
    if not sizes:
        return {}
    # so that what is ranked doesn't grow with the input: a hash below that of about eight times as many rows
    below = [(r["lang"], min((1 << 63) - 1, int(min(1.0, 8 * per_lang / max(r["n"], 1)) * (1 << 64)) - (1 << 63))) for r in sizes]
    limits = docs.sparkSession.createDataFrame(below, "lang string, below long")
    n = max(2, -(-most_chars // piece))
    spread = F.expr(f"array_join(transform(sequence(0, {n - 1}), i -> substring(text, cast(1 + cast(i AS bigint) * (length(text) - {piece}) div {n - 1} AS int), {piece})), ' ')")
    near = rows.join(F.broadcast(limits), "lang").where("h <= below").withColumn("text", F.when(F.length("text") <= most_chars, F.col("text")).otherwise(spread))
    few = near.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= per_lang)
    out: dict[str, list[tuple]] = {}
    for r in few.toArrow().to_pylist():
        out.setdefault(r["lang"], []).append((r["k"], r["text"]))
    return {lang: [t for _, t in sorted(v)] for lang, v in sorted(out.items())}


def _plain(text: str) -> str:
    """Lower-case letters; runs of other characters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def references(texts: dict[str, list[str]], chars: int = REFERENCE_CHARS, piece: int = PIECE) -> dict[str, str]:
    """One reference of at most ``chars`` for each language: a piece of each of its texts in turn, of the first text its
    first, of the second its second and so on, then the pieces after them."""
    out = {}
    for lang, all_ in texts.items():
        plain, got, size, k = [_plain(t) for t in all_], [], 0, 0
        while size < chars and any(len(p) > k * piece for p in plain):
            for j, p in enumerate(plain):
                n = -(-len(p) // piece)
                at = (j + k) % n * piece if k < n else len(p)
                part = p[at : at + piece]
                if part and size < chars:
                    got.append(part[: chars - size])
                    size += len(got[-1]) + 1
            k += 1
        if got:
            out[lang] = " ".join(got)
    return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def keyed(ref: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A reference's automaton as (width, sorted keys ``state * width + class``, next states, the root's next states)."""
    used = sorted(set(ref) - {" "})
    local = {c: i + 2 for i, c in enumerate(used)} | {" ": 0}
    width, auto = len(used) + 2, suffix_automaton([local[c] for c in ref])
    kind = np.int32 if len(auto) * width < 1 << 31 else np.int64
    moves = np.array([(i * width + c, s) for i, m in enumerate(auto) for c, s in sorted(m.items())], dtype=np.int64).reshape(-1, 2)
    root = np.zeros(width, dtype=kind)
    for c, s in auto[0].items():
        root[c] = s
    return width, moves[:, 0].astype(kind), moves[:, 1].astype(kind), root


def built(spark: SparkSession, refs: dict[str, str]) -> Broadcast | None:
    """The keyed automata of many languages, made by tasks and shipped once; None where they are few."""
    if len(refs) <= DENSE_LANGS:
        return None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, ref in zip(batch.column("lang").to_pylist(), batch.column("ref").to_pylist()):
                width, *arrays = keyed(ref)
                wide = arrays[0].dtype.itemsize
                yield pa.RecordBatch.from_pydict({"lang": [lang], "width": pa.array([width], pa.int32()), "wide": pa.array([wide], pa.int32()), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("keys", "moves", "root"), arrays)}})

    rows = spark.createDataFrame(sorted(refs.items()), "lang string, ref string").repartition(min(len(refs), 200), "lang")
    got = rows.mapInArrow(make, "lang string, width int, wide int, keys binary, moves binary, root binary").toArrow().to_pylist()  # about half a megabyte a language
    return spark.sparkContext.broadcast({r["lang"]: (r["width"], *(np.frombuffer(r[n], dtype=f"<i{r['wide']}") for n in ("keys", "moves", "root"))) for r in got})


class Model:
    """Automata of all languages, each over the letters of its own reference (class 0: space, 1: any other letter).

    Those of few letters are one table: entry ``state + class`` is ``next state * 2 + (a phrase ended)``. The others, as
    of Chinese, are sorted keys ``state * width + class`` with the next states; what isn't there goes on at the root's.
    """

    def __init__(self, refs: dict[str, str], autos: dict[str, tuple] | None = None):
        self.langs = sorted(refs)
        letters: dict[str, int] = {}
        for r in refs.values():
            for c in r:
                letters[c] = letters.get(c, 0) + 1
        letters.pop(" ", None)
        code = {c: i + 2 for i, c in enumerate(sorted(letters))} | {" ": 0}
        self.of = np.zeros(0x110000, dtype=np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                self.of[i] = code.get(low if len(low) == 1 else c, 1)
        tables, self.roots, self.bits, at = [], [], [], 0
        self.own = np.ones((len(self.langs), len(letters) + 2), dtype=np.int32)
        self.own[:, 0] = 0
        self.dense, self.sparse = [], {}
        for k, lang in enumerate(self.langs):
            used = sorted(set(refs[lang]) - {" "})
            local = {c: i + 2 for i, c in enumerate(used)} | {" ": 0}
            self.own[k, [code[c] for c in used]] = np.arange(2, len(used) + 2)
            width = len(used) + 2
            self.bits.append(math.log2(max(2, len(refs[lang]))))
            if autos is not None or width > DENSE:
                self.sparse[k] = autos[lang] if autos is not None else keyed(refs[lang])
                continue
            auto = suffix_automaton([local[c] for c in refs[lang]])
            root = np.full(width, at, dtype=np.int64)
            for c, s in auto[0].items():
                root[c] = at + s * width
            t = np.tile(root * 2 + 1, (len(auto), 1))
            for i, moves in enumerate(auto):
                for c, s in moves.items():
                    t[i, c] = (at + s * width) * 2
            tables.append(t.ravel())
            self.dense.append(k)
            self.roots.append(at)
            at += t.size
        # entries are up to twice the table's size
        kind = np.int32 if 2 * at < 1 << 31 else np.int64
        self.table = np.concatenate([t.astype(kind) for t in tables]) if tables else np.zeros(0, kind)

    def rates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a character of each text in each language, letters in each text)."""
        n = np.array([len(t or "") for t in texts], dtype=np.int64)
        raw = self.of[np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        doc = np.repeat(np.arange(len(texts)), n)
        letters = np.bincount(doc[raw > 0], minlength=len(texts))
        if not len(raw):
            return np.zeros((len(texts), len(self.langs))), letters
        first = np.ones(len(raw), dtype=bool)
        first[1:] = doc[1:] != doc[:-1]
        keep = (raw > 0) | ~(first | np.concatenate([[True], raw[:-1] == 0]))
        codes, doc = raw[keep], doc[keep]
        size = np.bincount(doc, minlength=len(texts))
        start = np.cumsum(size) - size
        # blocks, the longest first, so that those still walking come first at every step
        count = -(-size // BLOCK)
        of = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        lo = start[of] + nth * BLOCK
        long = np.minimum(BLOCK, size[of] - nth * BLOCK)
        order = np.argsort(-long, kind="stable")
        of, lo, long = of[order], lo[order], long[order]
        phrases = np.zeros((len(self.langs), len(of)), dtype=np.int64)
        live = np.searchsorted(-long, -np.arange(BLOCK), side="left")  # blocks longer than j
        steps = int(long[0]) if len(long) else 0
        if self.dense:
            own, some = self.own[self.dense][:, codes], np.zeros((len(self.dense), len(of)), dtype=np.int64)
            state = np.repeat(np.array(self.roots, dtype=self.table.dtype)[:, None], len(of), axis=1)
            for j in range(steps):
                m = live[j]
                v = self.table[state[:, :m] + own[:, lo[:m] + j]]
                some[:, :m] += v & 1
                state[:, :m] = v >> 1
            phrases[self.dense] = some
        for k, (width, keys, to, start) in self.sparse.items():
            own, state = self.own[k].astype(keys.dtype)[codes], np.zeros(len(of), dtype=keys.dtype)
            for j in range(steps):
                m = live[j]
                c = own[lo[:m] + j]
                key = state[:m] * keys.dtype.type(width) + c
                spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found = keys[spot] == key
                phrases[k, :m] += ~found
                state[:m] = np.where(found, to[spot], start[c])
        out = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            total = np.bincount(of, weights=phrases[k], minlength=len(texts)) + count  # the last phrase of each block
            out[:, k] = total * self.bits[k] / np.maximum(size, 1)
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, bits a character) of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rate, letters = self.rates(texts)
        best = rate.argmin(axis=1)
        low = rate[np.arange(len(texts)), best]
        score = 1 / np.exp(-SHARPNESS * (rate - low[:, None])).sum(axis=1)
        none = letters == 0
        return ["und" if z else self.langs[b] for b, z in zip(best, none)], np.where(none, 0.0, score), np.where(none, 0.0, low)


_models: dict[str, Model] = {}


def model(refs: dict[str, str], autos: Broadcast | None = None) -> Model:
    key = hashlib.sha256(repr(sorted(refs.items())).encode()).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(refs, autos.value if autos is not None else None)
        common.release()
    return _models[key]


def _chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str | None]]:
    chunk, held = [], 0
    for t in texts:
        chunk.append(t)
        held += len(t or "")
        if held >= most:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def _predict(refs: dict[str, str], autos: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(refs, autos)
        for batch in batches:
            langs, scores, bits = [], [], []
            for chunk in _chunks(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                a, b, c = m.predict(chunk)
                langs += a
                scores += b.tolist()
                bits += c.tolist()
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "__lang_pred", "__score", "__bits"])

    return common.trimmed(run)


def with_language(docs: DataFrame, learn: Column | None = None, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with __lang_pred, __score (0 to 1) and __bits (bits a character in that language) added.

    ``learn``: the rows whose lang and text may be learned from (all with a lang, if not given).
    """
    common.prepare(docs.sparkSession)
    refs = references(sample(docs, F.lit(True) if learn is None else learn, per_lang))
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predict(refs, built(docs.sparkSession, refs)), f"{fields}, __lang_pred string, __score double, __bits double")


def predict(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents whose crc32(doc_id) mod ``folds`` is not ``held``."""
    fold = common.crc_mod("doc_id", folds)
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    refs = references(sample(rows, fold != held))
    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.select("doc_id", "text").mapInArrow(_predict(refs, built(docs.sparkSession, refs)), f"doc_id {kind}, text string, __lang_pred string, __score double, __bits double")
    return out.select("doc_id", (fold == held).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.round("__bits", 4).alias("bits_per_char"))
