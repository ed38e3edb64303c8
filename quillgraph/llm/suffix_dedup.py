"""Repeated passages by range-partitioned suffixes.

A byte of a text is repeated if a string of ``width`` bytes that covers it also starts in a document with a smaller id.

* Texts are kept as shards of some megabytes, in a table bucketed by shard, so that later steps join to them without moving them.
* Suffixes are those that start at an anchor: the 16 bytes of least hash in each window of ``width`` bytes. Equal windows have the
  same anchor at the same place, so no repeat is lost, and there is a suffix for about 18 bytes. A first pass finds anchors whose
  hash occurs in more than one document (a superset of those with a repeat); the others need no further work.
* The suffixes left, with as many bytes before the anchor as its windows need, are range-partitioned by their leading 16 bytes with
  splitters from a sample. A leading text that fills a whole range is split further, window by window, by splitters of
  ``width`` bytes. Equal pieces of a shard travel once, with their least id.
* A bucket sorts its windows by multikey quicksort, eight bytes a step; runs of equal windows have their least id. A window that
  fills whole ranges by itself lies in several buckets; its least ids are compared across their boundaries.

Defined results: null and empty texts have no bytes and lose none; texts below ``width`` bytes lose none; a row without an id comes
after all others, so it loses what it shares with a row that has one, and rows that share an id, or have none, take nothing from each
other; rows that are repeated with one id are equal results. Only ``doc_id`` and ``text`` are read, so other columns may have
any name; an empty table gives no rows. A text of any length is one shard at most, worked on in parts.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common

WIDTH, GRAM = 50, 16
#: Bytes of text in a shard, and windows that are looked at together: bound a worker's memory.
SHARD_BYTES, PART = 4 << 20, 1 << 20
#: Anchor hashes, and windows, in one bucket.
HASHES, WINDOWS = 1_000_000, 500_000
#: Shards, and suffixes of each, in the sample for splitters.
SAMPLE_SHARDS, SAMPLE_SUFFIXES = 256, 512
#: Spark's limit on buckets of a table.
MOST_BUCKETS = 100_000
#: The id of rows without one: after all others.
LAST = np.iinfo(np.int64).max


def _zip(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _unzip(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place, by doubling."""
    h = _TABLE[data]
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xD1B54A32D192ED03), (4, 0xABC98388FB8FAC03), (8, 0x8CB92BA72F3D8DD7)):
        h = h[:-step] * np.uint64(factor) + h[step:]
    return _mixed(h)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of ``n`` values from each place."""
    done = 1
    while 2 * done <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if done < n else x


class Shard:
    """Some texts with their ids, and the windows of ``width`` bytes of each anchor: from ``first``, ``n`` of them, anchor at ``at``."""

    def __init__(self, row: dict, width: int):
        self.sid, self.width = row["sid"], width
        self.data = np.frombuffer(_unzip(row["texts"]), dtype=np.uint8)
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=bool)
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        got = [x for k in range(0, max(1, len(self.data) - width + 1), PART) for x in self._windows(k)]
        self.first, self.n, self.at, self.hash, self.doc = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
        self.id = self.ids[self.doc]

    def _windows(self, begin: int) -> Iterator[tuple]:
        data = self.data[begin : begin + PART + self.width - 1]
        if len(data) < self.width:
            return
        h, low = _grams(data), np.uint64(0xFFFFFFFF)
        # the least hash, and the leftmost of equals, which both follow from the window's bytes
        key = _least((h & ~low) | np.arange(len(h), dtype=np.uint64), self.width - GRAM + 1)
        at = (key & low).astype(np.int64)
        # windows start from each text's first byte up to where they would pass its end
        last = np.clip(self.starts + self.lengths - self.width + 1 - begin, 0, len(key))
        start = np.minimum(np.clip(self.starts - begin, 0, len(key)), last)
        new = np.concatenate([[True], at[1:] != at[:-1]])
        new[start[start < last]] = True
        change = np.zeros(len(key) + 1, np.int8)
        change[start[start < last]] += 1
        change[last[start < last]] -= 1
        whole = np.cumsum(change[:-1], dtype=np.int8) > 0
        after = np.concatenate([whole[1:], [False]])
        stop = np.flatnonzero(whole & (~after | np.concatenate([new[1:], [True]])))  # the last window of each run
        new = np.flatnonzero(whole & new)
        if len(new):
            # anchors have the least hashes of all: mixed anew, theirs are even over all buckets
            yield new + begin, stop - new + 1, at[new] + begin, _mixed(~h[at[new]]), np.searchsorted(self.starts, new + begin, side="right") - 1

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct anchor hashes in order, whether several documents of the shard have it, each anchor's place among them)."""
        values, place = np.unique(self.hash, return_inverse=True)
        low, high = np.full(len(values), LAST), np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(low, place, self.id)
        np.maximum.at(high, place, self.id)
        return values, low < high, place

    def marked(self, answers: list[dict], buckets: int) -> np.ndarray:
        """Anchors that the answers of the first pass mark."""
        values, _, place = self.hashes()
        owner, mark = _range_of(values, buckets), np.zeros(len(values), bool)
        for a in answers:
            own = slice(*np.searchsorted(owner, [a["bucket"], a["bucket"] + 1]))
            mark[own] = np.unpackbits(np.frombuffer(a["bits"], dtype=np.uint8), count=own.stop - own.start)
        return mark[place]


def _range_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Splitters:
    """Sorted samples of (leading bytes, window): what leads is kept together but for leads that fill a whole range."""

    def __init__(self, cuts: np.ndarray, width: int):
        self.width, self.cuts = width, cuts
        self.leads = np.ascontiguousarray(cuts.view(np.uint8).reshape(len(cuts), -1)[:, :GRAM]).view(f"S{GRAM}").ravel()
        same = lambda x: np.unique(x[1:][x[1:] == x[:-1]])
        self.heavy, self.straddling = same(self.leads), same(cuts)

    def bucket(self, lead: np.ndarray, window: np.ndarray, heavy: np.ndarray, sid: str) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, place among the straddling windows or -1) of rows of leading bytes and first windows."""
        out, edge = np.searchsorted(self.leads, lead), np.full(len(lead), -1)
        if heavy.any():
            key = _joined(lead[heavy], window[heavy])
            low, high = np.searchsorted(self.cuts, key), np.searchsorted(self.cuts, key, side="right")
            out[heavy] = low + np.where(high - low > 1, zlib.crc32(sid.encode()) % np.maximum(high - low, 1), 0)
            if len(self.straddling):
                k = np.minimum(np.searchsorted(self.straddling, key), len(self.straddling) - 1)
                edge[heavy] = np.where(self.straddling[k] == key, k, -1)
        return out, edge


def _joined(lead: np.ndarray, window: np.ndarray) -> np.ndarray:
    rows = np.hstack([lead.view(np.uint8).reshape(len(lead), -1), window])
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


class Pieces:
    """Distinct pieces of a shard: ``n`` windows and their bytes, the least id, the bucket; ``of``: the piece of each occurrence."""

    def __init__(self, shard: Shard, marked: np.ndarray, splitters: Splitters | None):
        width = shard.width
        first, n, at, ids = (x[marked] for x in (shard.first, shard.n, shard.at, shard.id))
        padded = np.concatenate([shard.data, np.zeros(2 * width, np.uint8)])
        bytes_at = lambda where, size: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, size)[where])
        lead = bytes_at(at, GRAM).view(f"S{GRAM}").ravel()
        heavy = np.isin(lead, splitters.heavy) if splitters is not None else np.zeros(len(lead), bool)
        if heavy.any():  # window by window
            times = np.where(heavy, n, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first, n, ids, lead, heavy = np.repeat(first, times) + step, np.repeat(np.where(heavy, 1, n), times), np.repeat(ids, times), np.repeat(lead, times), np.repeat(heavy, times)
        self.first, self.ids = first, ids
        size = 2 * width - GRAM
        rows = bytes_at(first, size)
        rows[np.arange(size) >= (n + width - 1)[:, None]] = 0
        self.of, some = _distinct(n, rows)
        self.n, self.rows = n[some], rows[some]
        self.least = np.full(len(some), LAST)
        np.minimum.at(self.least, self.of, ids)
        self.lead, self.window = lead[some], self.rows[:, :width]
        if splitters is not None:
            self.bucket, self.edge = splitters.bucket(self.lead, self.window, heavy[some], shard.sid)
            self.order = np.argsort(self.bucket, kind="stable")

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket with its pieces, in an order that follows from the shard alone."""
        owner = self.bucket[self.order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner)) if len(owner) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(owner[a]), self.order[a:b]


def _distinct(n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's distinct value, a row of each value) of window counts with bytes."""
    wide = np.ascontiguousarray(np.hstack([n.astype("<u2")[:, None].view(np.uint8), rows]))
    coded = pa.Array.from_buffers(pa.binary(wide.shape[1]), len(wide), [None, pa.py_buffer(wide)]).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    some = np.zeros(len(coded.dictionary), np.int64)
    some[code[::-1]] = np.arange(len(code))[::-1]
    return code, some


def equal_windows(rows: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows that have an equal, in order, number of their run), by multikey quicksort on eight bytes a step.

    ``starts`` are places in the flattened ``rows``. Windows that are alone after a step take no part in the next.
    """
    flat = np.concatenate([rows.ravel(), np.zeros(8, np.uint8)]).astype(np.uint64)
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        flat = (flat[:-step] << np.uint64(bits)) | flat[step:]
    who, run = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        key = flat[starts[who] + k]
        order = np.lexsort((key, run))
        who, run, key = who[order], run[order], key[order]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (key[1:] != key[:-1])])[: len(who)]
        size = np.diff(np.append(np.flatnonzero(new), len(who)))
        stay = np.repeat(size > 1, size)
        who, run = who[stay], np.cumsum(new)[stay]
    return who, run


def _pack(width: int):
    """Rows of (doc_id, text) to shards."""

    def shard(ids: list, texts: list) -> pa.RecordBatch:
        known = np.array([i is not None for i in ids], bool)
        raw = [t.encode() if t else b"" for t in texts]
        numbers = np.array([LAST if i is None else i for i in ids], np.int64)
        lengths = np.array([len(t) for t in raw], np.int64)
        return pa.RecordBatch.from_pydict({
            "sid": [uuid.uuid4().hex], "ids": [numbers.tobytes()], "known": [known.tobytes()], "lengths": [lengths.tobytes()],
            "texts": [_zip(b"".join(raw))], "size": [int(lengths.sum())],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if ids and size + len(t or "") > SHARD_BYTES:
                    yield shard(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield shard(ids, texts)

    return common.trimmed(run)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _planes(x: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte by byte of equal weight, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _send_hashes(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard = Shard(row, width)
            values, several, _ = shard.hashes()
            owner = _range_of(values, buckets)
            edges = np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner)) if len(owner) else [0]
            parts = list(zip(edges, edges[1:], strict=False))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([int(owner[a]) for a, _ in parts], pa.int64()), "sid": pa.array([shard.sid] * len(parts), pa.string()),
                "hashes": pa.array([_planes(values[a:b]) for a, b in parts], pa.binary()), "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in parts], pa.binary()),
            })

    return common.trimmed(run)


def _shared_hashes(group: pa.Table) -> pa.Table:
    """Of each shard's hashes in a bucket, a bit for those that several documents have."""
    sids, parts = group.column("sid").to_pylist(), [_unplaned(b) for b in group.column("hashes").to_pylist()]
    several = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=len(p)) for b, p in zip(group.column("several").to_pylist(), parts, strict=True)]
    values, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    count += np.bincount(place, weights=np.concatenate(several), minlength=len(values)).astype(np.int64)
    mark = np.split(count[place] > 1, np.cumsum([len(p) for p in parts])[:-1])
    common.release()
    keep = [k for k, m in enumerate(mark) if m.any()]
    return pa.table({
        "sid": pa.array([sids[k] for k in keep], pa.string()), "bucket": pa.array([group.column("bucket")[0].as_py()] * len(keep), pa.int64()),
        "bits": pa.array([np.packbits(mark[k]).tobytes() for k in keep], pa.binary()), "marks": pa.array([int(mark[k].sum()) for k in keep], pa.int64()),
    })


def _sample(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard = Shard(row, width)
            p = Pieces(shard, shard.marked(row["marks"], buckets), None)
            some = np.unique(np.linspace(0, len(p.n) - 1, min(len(p.n), SAMPLE_SUFFIXES)).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"key": pa.array([a.tobytes() for a in _joined(p.lead[some], p.window[some])] if len(some) else [], pa.binary())})

    return common.trimmed(run)


def _send_suffixes(width: int, buckets: int, cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = Splitters(cuts.value, width)
        for row in _rows(batches):
            shard = Shard(row, width)
            p = Pieces(shard, shard.marked(row["marks"], buckets), splitters)
            inside = np.arange(p.rows.shape[1]) < (p.n + width - 1)[:, None]
            sent = [(b, p.n[own].astype("<u2").tobytes(), p.least[own].tobytes(), p.edge[own].astype("<i4").tobytes(), _zip(p.rows[own][inside[own]].tobytes())) for b, own in p.parts()]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([x[0] for x in sent], pa.int64()), "sid": pa.array([shard.sid] * len(sent), pa.string()),
                **{name: pa.array([x[k + 1] for x in sent], pa.binary()) for k, name in enumerate(("n", "least", "edge", "rows"))},
            })

    return common.trimmed(run)


def _sorted_bucket(width: int):
    """A bucket's answer: of each shard's pieces, a bit for each window that starts in an earlier document; least ids of straddling windows."""

    def run(group: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(b, dtype=kind) for b in group.column(name).to_pylist()]
        parts = read("n", "<u2")
        n, least, edge = (np.concatenate(x).astype(np.int64) for x in (parts, read("least", np.int64), read("edge", "<i4")))
        size = 2 * width - GRAM
        rows = np.zeros((len(n), size), np.uint8)
        rows[np.arange(size) < (n + width - 1)[:, None]] = np.frombuffer(b"".join(_unzip(b) for b in group.column("rows").to_pylist()), dtype=np.uint8)
        of, some = _distinct(n, rows)
        first = np.full(len(some), LAST)
        np.minimum.at(first, of, least)
        # windows of distinct pieces only: the others of a piece come after its first
        count = n[some]
        begin = np.cumsum(count) - count
        piece = np.repeat(np.arange(len(some)), count)
        starts = piece * size + np.arange(count.sum()) - begin[piece]
        who, run_ = equal_windows(rows[some], starts, width)
        repeated = np.zeros(len(starts), bool)
        if len(who):
            ids = first[piece[who]]
            new = np.flatnonzero(np.concatenate([[True], run_[1:] != run_[:-1]]))
            least_of_run = np.minimum.reduceat(ids, new)
            repeated[who] = np.repeat(least_of_run, np.diff(np.append(new, len(who)))) < ids
        at = np.repeat(begin[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bits = repeated[at] | np.repeat(least > first[of], n)
        out = np.split(bits, np.cumsum([int(p.sum()) for p in parts])[:-1])
        held = np.unique(edge[edge >= 0])
        low = np.full(int(held[-1]) + 1 if len(held) else 0, LAST)
        np.minimum.at(low, edge[edge >= 0], least[edge >= 0])
        del rows, repeated, bits, at, who, run_
        common.release()
        sids, bucket = group.column("sid").to_pylist(), group.column("bucket")[0].as_py()
        keep = [k for k, b in enumerate(out) if b.any()]
        return pa.table({
            "sid": pa.array([sids[k] for k in keep] + [None] * len(held), pa.string()), "bucket": pa.array([bucket] * (len(keep) + len(held)), pa.int64()),
            "bits": pa.array([np.packbits(out[k]).tobytes() for k in keep] + [None] * len(held), pa.binary()),
            "edge": pa.array([None] * len(keep) + held.tolist(), pa.int64()), "least": pa.array([None] * len(keep) + low[held].tolist(), pa.int64()),
        })

    return run


def _without_repeats(width: int, buckets: int, cuts, edges):
    """Each text's spans that are repeated, and what is left of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = Splitters(cuts.value, width) if cuts is not None else None
        for row in _rows(batches):
            shard = Shard(row, width)
            change = np.zeros(len(shard.data) + 1, np.int32)
            if splitters is not None and row["marks"]:
                p = Pieces(shard, shard.marked(row["marks"], buckets), splitters)
                begin, bits = np.cumsum(p.n) - p.n, np.zeros(p.n.sum(), bool)
                answers = {a["bucket"]: a["bits"] for a in row["repeats"] or []}
                for b, own in p.parts():
                    if b in answers:
                        n = p.n[own]
                        bits[np.repeat(begin[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.unpackbits(np.frombuffer(answers[b], dtype=np.uint8), count=int(n.sum()))
                n = p.n[p.of]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                gone = bits[np.repeat(begin[p.of], n) + step] | np.repeat(p.ids > p.least[p.of], n)
                least = np.concatenate([edges.value, [LAST]])[p.edge[p.of]]  # the last stands for no edge
                gone |= np.repeat(p.ids > least, n)
                starts = (np.repeat(p.first, n) + step)[gone]
                np.add.at(change, starts, 1)
                np.add.at(change, starts + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            yield _result(shard, gone)

    return common.trimmed(run)


def _result(shard: Shard, gone: np.ndarray) -> pa.RecordBatch:
    ends = shard.starts + shard.lengths
    border = np.zeros(len(gone) + 1, bool)
    border[shard.starts] = border[ends] = True
    before, after = np.concatenate([[False], gone]), np.concatenate([gone, [False]])
    begins = np.flatnonzero(after & (~before | border))
    stops = np.flatnonzero(before & (~after | border))
    doc = np.searchsorted(shard.starts, begins, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(begins - shard.starts[doc]), pa.array(stops - shard.starts[doc])], ["start", "stop"])
    per = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(shard.ids)))]).astype(np.int32)
    kept = np.concatenate([[0], np.cumsum(~gone)])
    offsets = np.append(kept[shard.starts], kept[-1]).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(shard.ids, pa.int64(), mask=~shard.known), pa.array(shard.lengths), pa.ListArray.from_arrays(pa.array(per), spans),
        pa.Array.from_buffers(pa.binary(), len(shard.ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(shard.data[~gone]))]),
    ], names=["doc_id", "n_bytes", "spans", "kept"])


def _bucketed(spark: SparkSession, shards: DataFrame, path: str, buckets: int) -> DataFrame:
    """``shards`` written to ``path`` in buckets by ``sid``; the table's name is only needed to write it."""
    name = f"shards_{uuid.uuid4().hex}"
    shards.write.format("parquet").bucketBy(buckets, "sid").option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved while the name is there
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return table


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the repeated spans of each text, in bytes, and its other bytes in a row."""
    if width <= GRAM:
        raise ValueError(f"width must be over {GRAM}")
    spark = docs.sparkSession
    common.prepare(spark)
    base = common.run_dir(spark, "suffixes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(_pack(width), "sid string, ids binary, known binary, lengths binary, texts binary, size long")
    shards = _bucketed(spark, packed, f"{base}/shards", min(max(8, rows.rdd.getNumPartitions()), MOST_BUCKETS))
    total = shards.agg(F.sum("size")).first()[0] or 0
    buckets = max(4, math.ceil(total / ((width - GRAM) / 2 * HASHES)))
    hashes = shards.mapInArrow(_send_hashes(width, buckets), "bucket long, sid string, hashes binary, several binary")
    marks = common.stored(hashes.groupBy("bucket").applyInArrow(_shared_hashes, "sid string, bucket long, bits binary, marks long"), f"{base}/marks")
    n_marks = marks.agg(F.sum("marks")).first()[0] or 0
    of_shard = marks.groupBy("sid").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))
    out = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    nothing = F.lit(None).cast("array<struct<bucket: bigint, bits: binary>>")
    if not n_marks:
        return shards.withColumn("marks", nothing).withColumn("repeats", nothing).mapInArrow(_without_repeats(width, buckets, None, None), out)
    few = [r["sid"] for r in marks.select("sid").distinct().orderBy(F.xxhash64("sid")).limit(SAMPLE_SHARDS).collect()]
    sample = shards.join(F.broadcast(of_shard.where(F.col("sid").isin(few))), "sid").mapInArrow(_sample(width, buckets), "key binary").toArrow()["key"].to_pylist()
    ranges = max(4, math.ceil(n_marks * (width - GRAM) / 2 / WINDOWS))
    keys = np.sort(np.array(sample, dtype=f"S{GRAM + width}"))
    cuts = spark.sparkContext.broadcast(keys[np.linspace(0, len(keys), ranges, endpoint=False).astype(np.int64)[1:]])
    marked = shards.join(of_shard.hint("shuffle_hash"), "sid")
    sent = marked.mapInArrow(_send_suffixes(width, buckets, cuts), "bucket long, sid string, n binary, least binary, edge binary, rows binary")
    found = common.stored(sent.groupBy("bucket").applyInArrow(_sorted_bucket(width), "sid string, bucket long, bits binary, edge long, least long"), f"{base}/repeats")
    # windows in several buckets, at most one for two splitters: their least ids over the boundaries
    edges = np.full(len(Splitters(cuts.value, width).straddling), LAST)
    for r in found.where("edge IS NOT NULL").groupBy("edge").agg(F.min("least").alias("least")).collect():
        edges[r["edge"]] = r["least"]
    answers = found.where("sid IS NOT NULL").groupBy("sid").agg(F.collect_list(F.struct("bucket", "bits")).alias("repeats"))
    both = of_shard.join(answers, "sid", "left")
    return shards.join(both.hint("shuffle_hash"), "sid", "left").mapInArrow(_without_repeats(width, buckets, cuts, spark.sparkContext.broadcast(edges)), out)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    found = repeats(docs)
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
