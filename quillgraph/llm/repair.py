"""Token-id files with Re-Pair grammar compression.

Documents are dealt out by ranges of doc_id, so file after file holds them in ascending order; the number of files follows
the bytes. A file is a row of shards, each with an alphabet and a grammar of its own: the pairs of neighbouring symbols
that are frequent in the shard become nonterminals, round after round, until none is frequent. The end-of-document id
takes part in no rule, so every document starts at a symbol.

File format, little-endian (``RP02``):
    shard   alphabet (uint32 id of each terminal), symbols (uint16, or uint32 where terminals and rules need it), rules
            (two symbols for each nonterminal, in the order of making), expansion lengths (uint32 for each nonterminal),
            documents (int64 doc_id, uint8 null flag, uint64 first symbol, uint64 first id; each as one array)
    footer  JSON: vocabulary size, end id, and for each shard its offset, counts, bytes of a symbol and first id
    tail    uint64 footer length, ``RP02``
A document is read by a seek to its shard and by expanding its symbols alone; expansion lengths give every position.

Defined results: a null text is the empty text, whose ids are just the end id; rows are written in ascending doc_id,
nulls first, equal ids in the order of their texts; texts are encoded whole; an empty table gives no files and no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import bpe_tree, common, files

MAGIC = b"RP02"
SHARD_IDS = 1 << 21
MIN_COUNT = 16
MOST_SYMBOLS = 1 << 20
MEMO_UNITS = 500_000
#: Bytes of the table (as Spark estimates them) that one file holds, and up to how many files their bounds are literals.
FILE_BYTES = 1 << 28
MOST_BOUNDS = 2048
MANIFEST_SCHEMA = "file string, part int, docs long, ids long"


# --- grammar ---------------------------------------------------------------------------------------------------------


def compress(ids: np.ndarray, vocab: int, barred: int, rounds: int | None = None, min_count: int = MIN_COUNT, most_symbols: int = MOST_SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, rules); rule k is the pair that nonterminal ``vocab + k`` stands for.

    A round replaces the pairs that occur at least ``min_count`` times, left to right where they overlap; rounds go on
    until no pair is so frequent or all symbols are used (``rounds`` limits them, if given). ``barred`` is in no pair.
    Pairs are counted exactly, by sorting them together with their places. After the first round only pairs can have
    become frequent that have a symbol of the last round, or that waited as too many of their places overlapped others.
    """
    bits = max(16, int(most_symbols - 1).bit_length())
    seq, made, held, fresh, waiting, turn = ids.astype(np.uint32), [np.empty((0, 2), dtype=np.int64)], vocab, 0, None, 0
    while len(seq) > 1 and held < most_symbols and (rounds is None or turn < rounds):
        if turn == 0:
            at, key = None, seq[:-1].astype(np.uint64)
            key <<= np.uint64(bits)
            key |= seq[1:]
        else:
            new = seq >= fresh
            if waiting is not None:
                new[:-1] |= waiting[seq[:-1]]
            at = np.flatnonzero(new[:-1] | (seq[1:] >= fresh))
            key = seq[at].astype(np.uint64)
            key <<= np.uint64(bits)
            key |= seq[at + 1]
        key, at = _sorted(key, at, bits, len(seq))
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(key)))
        often = np.flatnonzero(count >= min_count)
        pairs = key[edge[often]].astype(np.int64)
        a, b = pairs >> bits, pairs & ((1 << bits) - 1)
        open_ = (a != barred) & (b != barred)
        often, a, b = often[open_], a[open_], b[open_]
        if len(often) > most_symbols - held:
            most = np.sort(np.argsort(-count[often], kind="stable")[: most_symbols - held])
            often, a, b = often[most], a[most], b[most]
        if not len(often):
            break
        own = np.zeros(len(edge), dtype=np.uint32)
        own[often] = np.arange(1, len(often) + 1)
        label = np.zeros(len(seq), dtype=np.uint32)
        label[at] = np.repeat(own, count)
        hit = _apart(label)
        of = label[hit]
        # a pair that overlaps others may be left with few places: it waits
        used = np.bincount(of, minlength=len(often) + 1) >= 2
        n = int(used.sum())
        name = np.zeros(len(often) + 1, dtype=np.uint32)
        name[used] = np.arange(held, held + n)
        new = name[of]
        if n < len(often):
            hit, new = hit[new > 0], new[new > 0]
        seq[hit] = new
        stay = np.ones(len(seq), dtype=bool)
        stay[hit + 1] = False
        seq, used, waiting = seq[stay], used[1:], None
        if n < len(often):
            waiting = np.zeros(held + n, dtype=bool)
            waiting[a[~used]] = True
        made.append(np.stack([a[used], b[used]], axis=1))
        fresh, held, turn = held, held + n, turn + 1
        if not n:
            break
    return seq.astype(np.int64), np.concatenate(made)


def _sorted(key: np.ndarray, at: np.ndarray | None, bits: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair keys in order, and their places in ascending order among equal keys (all places if ``at`` is None)."""
    place = 64 - 2 * bits
    if length > 1 << place:  # no room for the place in the key's word
        order = np.argsort(key, kind="stable")
        return key[order], order if at is None else at[order]
    key <<= np.uint64(place)
    key |= np.arange(len(key), dtype=np.uint64) if at is None else at.astype(np.uint64)
    key.sort()
    at = (key & np.uint64((1 << place) - 1)).astype(np.int64)
    key >>= np.uint64(place)
    return key, at


def _apart(label: np.ndarray) -> np.ndarray:
    """Places with a label (each covers itself and the next place, the last has none) to take so that none overlap: left
    to right, which in a run of touching ones is every other one."""
    spots = np.flatnonzero(label)
    kind = np.int32 if len(label) < 1 << 31 else np.int64
    at = spots.astype(kind)
    first = np.where(label[spots - 1] == 0, at, kind(0))
    np.maximum.accumulate(first, out=first)
    at -= first
    at &= 1
    return spots[at == 0]


def levels(rules: np.ndarray, vocab: int) -> Iterator[tuple[int, int]]:
    """Stretches of rules that refer to symbols made before the stretch only (those of one round at least)."""
    top, lo = rules.max(axis=1) if len(rules) else np.zeros(0), 0
    while lo < len(rules):
        later = top[lo:] >= vocab + lo
        hi = lo + int(later.argmax()) if later.any() else len(rules)
        yield lo, hi
        lo = hi


def lengths(rules: np.ndarray, vocab: int) -> np.ndarray:
    """Expansion length of every symbol, terminals first."""
    out = np.ones(vocab + len(rules), dtype=np.int64)
    for lo, hi in levels(rules, vocab):
        out[vocab + lo : vocab + hi] = out[rules[lo:hi]].sum(axis=1)
    return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 31) else np.int64
    out = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, size: np.ndarray, vocab: int, alphabet: np.ndarray | None = None) -> np.ndarray:
    """The ids that ``symbols`` stand for; ``size`` has every symbol's expansion length, ``alphabet`` the terminals' ids."""
    start = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), dtype=np.uint32)
    flat[:vocab] = np.arange(vocab) if alphabet is None else alphabet
    for lo, hi in levels(rules, vocab):
        parts = rules[lo:hi].ravel()
        flat[start[vocab + lo] : start[vocab + lo] + int(size[parts].sum())] = flat[ragged(start[parts], size[parts])]
    return flat[ragged(start[symbols], size[symbols])]


# --- files -----------------------------------------------------------------------------------------------------------


class Writer:
    """Writes one file, shard by shard."""

    def __init__(self, out, vocab: int, end_id: int):
        self.out, self.vocab, self.end_id = out, vocab, end_id
        self.at, self.ids, self.docs, self.shards = 0, 0, 0, []

    def shard(self, doc_ids: list[int | None], ids: np.ndarray, firsts: np.ndarray) -> None:
        """``ids`` of whole documents; ``firsts`` has where each starts."""
        alphabet = np.flatnonzero(np.bincount(ids, minlength=self.vocab))
        local = np.zeros(self.vocab, dtype=np.uint32)
        local[alphabet] = np.arange(len(alphabet))
        symbols, rules = compress(local[ids], len(alphabet), int(local[self.end_id]))
        size = lengths(rules, len(alphabet))
        spot = np.cumsum(size[symbols]) - size[symbols]
        first_symbol = np.searchsorted(spot, firsts)
        symbol = np.dtype("<u2") if len(size) <= 1 << 16 else np.dtype("<u4")
        parts = [
            alphabet.astype("<u4"), symbols.astype(symbol), rules.astype(symbol), size[len(alphabet) :].astype("<u4"),
            np.array([d or 0 for d in doc_ids], dtype="<i8"), np.array([d is None for d in doc_ids], dtype="u1"),
            first_symbol.astype("<u8"), firsts.astype("<u8"),
        ]
        self.shards.append({"offset": self.at, "alphabet": len(alphabet), "symbols": len(symbols), "symbol_bytes": symbol.itemsize, "rules": len(rules), "docs": len(doc_ids), "ids": len(ids), "first_id": self.ids})
        for p in parts:
            self.out.write(p.tobytes())
            self.at += p.nbytes
        self.ids += len(ids)
        self.docs += len(doc_ids)

    def close(self) -> None:
        footer = json.dumps({"vocab": self.vocab, "end_id": self.end_id, "shards": self.shards}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads shards, or single documents by their place."""

    def __init__(self, uri: str):
        self.f = files.open_random(uri)
        end = self.f.size()
        self.f.seek(end - 12)
        tail = self.f.read(12)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no {MAGIC.decode()} file")
        n = int.from_bytes(tail[:8], "little")
        self.f.seek(end - 12 - n)
        self.about = json.loads(self.f.read(n))
        self.vocab = self.about["vocab"]

    def _arrays(self, s: dict) -> list[np.ndarray]:
        self.f.seek(s["offset"])
        symbol = f"<u{s['symbol_bytes']}"
        kinds = [("<u4", s["alphabet"]), (symbol, s["symbols"]), (symbol, 2 * s["rules"]), ("<u4", s["rules"]), ("<i8", s["docs"]), ("u1", s["docs"]), ("<u8", s["docs"]), ("<u8", s["docs"])]
        return [np.frombuffer(self.f.read(np.dtype(k).itemsize * n), dtype=k) for k, n in kinds]

    def shard(self, k: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """(doc_ids, all ids, where each document starts) of shard ``k``."""
        alphabet, symbols, rules, sizes, docs, null, _, firsts = self._arrays(self.about["shards"][k])
        size = np.concatenate([np.ones(len(alphabet), dtype=np.int64), sizes.astype(np.int64)])
        ids = expand(symbols.astype(np.int64), rules.reshape(-1, 2), size, len(alphabet), alphabet)
        return [None if z else d for d, z in zip(docs.tolist(), null.tolist())], ids, firsts.astype(np.int64)

    def document(self, k: int, place: int) -> np.ndarray:
        """The ids of one document: only its own symbols are expanded."""
        s = self.about["shards"][k]
        alphabet, symbols, rules, _, _, _, first_symbol, _ = self._arrays(s)
        lo = int(first_symbol[place])
        hi = int(first_symbol[place + 1]) if place + 1 < s["docs"] else s["symbols"]
        out, todo, rules = [], symbols[lo:hi].tolist()[::-1], rules.reshape(-1, 2).tolist()
        while todo:
            x = todo.pop()
            if x < len(alphabet):
                out.append(alphabet[x])
            else:
                a, b = rules[x - len(alphabet)]
                todo += [b, a]
        return np.array(out, dtype=np.uint32)

    def close(self) -> None:
        self.f.close()


# --- tables ----------------------------------------------------------------------------------------------------------


class _Packed(bpe_tree.UnitEncoder):
    """Keeps the ids of units as bytes, so that a text's ids are one join."""

    def __init__(self, path: str):
        super().__init__(path, MEMO_UNITS)
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")

        one = struct.Struct("<H" if self.kind.itemsize == 2 else "<I").pack
        self.one = [one(i) for i in range(self.vocab)]
        self.pieces = _Pieces(self)

    def keep(self, ids: list[int]) -> bytes:
        return b"".join([self.one[i] for i in ids])


    def pack(self, text: str, leaf_chars: int) -> bytes:
        """A text's ids as bytes.

        A text of ASCII and Latin-1 letters alone is cut by the tokenizer's own pattern, which then is the same in both
        regex dialects, and its pieces' ids come from the memo or the library's model; any other text goes the way of
        ``bpe_tree``.
        """
        if not self.splits or _OTHER.search(text) or "<|" in text:
            return b"".join(bpe_tree.tree(text, self, leaf_chars))
        return b"".join(map(self.pieces.__getitem__, _PIECE(text.lower())))


class _Pieces(dict):
    """Memo of the ids of lower-case pieces between which the tokenizer splits."""

    def __init__(self, owner: _Packed):
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            if len(piece) > bpe_tree.LEAF_CHARS:
                return b"".join(bpe_tree.tree(piece, self.owner))
            value = self.owner.keep(self.owner._word(piece) if piece.isalpha() else self.owner._whole(piece))
        self[piece] = value
        return value

    older: dict[str, bytes] = {}

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.older = dict(self)
            self.clear()


#: What makes a text go the general way: anything but ASCII (no separators 1C to 1F) and Latin-1 letters.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]")
#: Fixed value: the pattern at which the tokenizer cuts, for such texts in lower case.
_PIECE = re.compile("[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\\s0-9a-zß-öø-ÿ]+").findall


_packers: dict[str, _Packed] = {}


def _write(path: str, out_dir: str, end_id: int, shard_ids: int, leaf_chars: int):
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        enc = _packers.get(path) or _packers.setdefault(path, _Packed(path))
        end = np.array([end_id], dtype=enc.kind).tobytes()
        part = TaskContext.get().partitionId()
        uri = f"{out_dir}/part-{part:06d}.rp"

        def documents():
            import itertools

            for b in itertools.chain([first], batches):
                names, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                at = 0
                for group in bpe_tree.groups(texts):
                    enc.turn()
                    enc.pieces.turn(MEMO_UNITS)
                    for t in group:
                        yield names[at], enc.pack(t, leaf_chars) + end
                        at += 1

        with files.new_file(uri) as out:
            w = Writer(out, enc.vocab, end_id)
            docs, data, n = [], [], 0

            def flush():
                sizes = np.array([len(x) for x in data], dtype=np.int64) // enc.kind.itemsize
                w.shard(docs, np.frombuffer(b"".join(data), dtype=enc.kind), np.cumsum(sizes) - sizes)

            for name, packed in documents():
                docs.append(name)
                data.append(packed)
                n += len(packed) // enc.kind.itemsize
                if n >= shard_ids:
                    flush()
                    docs, data, n = [], [], 0
            if docs:
                flush()
            w.close()
        yield pa.record_batch([[uri], pa.array([part], pa.int32()), [w.docs], [w.ids]], schema=schema)

    return run


def by_range(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ranges of a number, nulls first, into at least as many as there are shuffle partitions, and so
    many that each has about ``FILE_BYTES``.

    The bounds come from a scan of the key alone, which ``repartitionByRange`` would take from whole rows; beyond
    ``MOST_BOUNDS`` of them they would make too large an expression, and it does the job.
    """
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size >= 1 << 60:  # Spark has no estimate
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    if n > MOST_BOUNDS:
        return rows.repartitionByRange(n, F.col(key).asc_nulls_first())
    bounds = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n) if n > 1 else F.lit(None)).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.coalesce(_searched(key, bounds), F.lit(0))
    return rows.repartitionById(len(bounds) + 1, part)


def _searched(key: str, bounds: list[int]) -> Column:
    """How many bounds the key is above: a search by halves in an array literal, whose steps grow with its logarithm."""
    if not bounds:
        return F.lit(0)
    all_ = F.array(*map(F.lit, bounds))
    ends = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def step(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        done, above = a["lo"] >= a["hi"], F.get(all_, mid) < F.col(key)
        return F.when(done, a).when(above, ends(mid + 1, a["hi"])).otherwise(ends(a["lo"], mid))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), ends(F.lit(0), F.lit(len(bounds))), step)
    return F.when(F.col(key).isNotNull(), found["lo"])


def write_ids(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 1, shard_ids: int = SHARD_IDS, leaf_chars: int = bpe_tree.LEAF_CHARS) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; gives the manifest (file, part, docs, ids)."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = by_range(rows, "doc_id").sortWithinPartitions("doc_id", "text")
    # a row for each file: their number follows the partitions, so the driver may hold the list
    files_ = rows.mapInArrow(_write(tokenizer_path, out_dir, end_id, shard_ids, leaf_chars), MANIFEST_SCHEMA).toArrow()
    return docs.sparkSession.createDataFrame(files_, MANIFEST_SCHEMA)


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document of the files in a manifest."""
    spark = manifest.sparkSession
    # one row for each file: their count follows the partitions, not the documents
    based = manifest.withColumn("base", F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    n = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                r = Reader(uri)
                for k, s in enumerate(r.about["shards"]):
                    docs, ids, firsts = r.shard(k)
                    ends = np.append(firsts[1:], len(ids))
                    data = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(firsts.tolist(), ends.tolist())]
                    out = [pa.array(docs, pa.int64()), pa.array(firsts + (base or 0) + s["first_id"]), pa.array(ends - firsts), pa.array(crc, pa.int64())]
                    if with_ids:
                        out.append(pa.array([ids[i:j].tolist() for i, j in zip(firsts, ends)], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                r.close()

    return based.select("file", "base").repartition(n).mapInArrow(run, schema)


def id_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, out_dir: str | None = None) -> DataFrame:
    """Write the id files of ``docs`` and read them back."""
    return read_ids(write_ids(docs, tokenizer_path, out_dir or common.run_dir(spark, "ids")))
