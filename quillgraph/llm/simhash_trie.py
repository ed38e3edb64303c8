"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of equal value are one trie leaf, so exact copies cost one row. Two fingerprints within ``budget`` bits
agree on at least one of ``budget + 1`` bit blocks, so the trie is kept in that many rotations, each with another block
on top: the top node pairs of a rotation then have no differing bit and are nodes joined with themselves. Each such
node is a group of rows. In a group the trie below is walked by node pairs together: a pair splits into its four child
pairs, differing bits are summed, and pairs over the budget are pruned. A group over ``split_over`` fingerprints is
dealt out by pairs of its nodes some levels further down, whose differing bits are at most the budget.

A group gives a spanning forest of its links, not all its pairs; components come from the union of the forests.

Texts of a similarity of 0.8 on five words differ in about ten of 64 bits, where bit blocks that agree are too short to
part the trie. ``one_of_each`` takes wide fingerprints of ``LIMBS`` x 64 bits of the distinct shingles, and the top nodes
of its trie are ``BANDS`` keys of ``ROWS`` least shingle hashes each in place of bit blocks. Below them the same walk sums
differing bits over the wide fingerprint. ``WIDE_BUDGET`` bits of 256 are a similarity of about 0.7: the fingerprint
estimates it within some hundredths, so the budget lies below 0.8 to find those of 0.8. In groups over ``PIVOT_OVER`` rows, rows within
``TIGHT`` bits of a pivot, the middle one, are paired with it first, and others with it and the nearest of them. A group gives these
pairs and the forest of the nearest of its other pairs, and each of these pairs is checked on the texts' shingles: only pairs of a similarity of 0.8 or more are links. What may be
missed: pairs that share no key, or lie over the budget, or whose texts are joined in the forest by pairs that fail the check.

Defined results: a text without words (null, empty, white space) has fingerprint zero and links like any other; texts
with one or two words have one shingle; repeated rows share fingerprint and component; null ids never are a component
id unless no reachable id is known (then it is null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common
from quillgraph.llm.components import components

BITS = 64
SEED = 42
SPLIT_OVER = 50_000
LEAF = 8  # node pairs of so few fingerprints are compared outright
LIMBS = 4
WIDE_BUDGET = 50
BANDS, ROWS = 8, 3
PIVOT_OVER, PIVOTS, TIGHT, NEAREST = 256, 16, 24, 2
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, LIMBS + BANDS * ROWS + 1, dtype=np.uint64) * _GOLDEN)[:, None]
_BAND_SEEDS = np.arange(1, BANDS + 1, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text's word shingles; bit set where over half the shingle hashes have it."""
    h = _shingles(text, words)
    return _majority(h) if len(h) else 0


def _shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's word shingles in order: the whole sequence where it has fewer words, none without a word."""
    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, dtype=np.uint64)
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)


def wide_fingerprint(text: str | None, words: int = 5) -> tuple[bytes, np.ndarray]:
    """Wide SimHash of a text's distinct shingles, and its band keys; both are zero for a text without words."""
    h = np.unique(_shingles(text, words))
    if not len(h):
        return bytes(8 * LIMBS), np.zeros(BANDS, dtype=np.uint64)
    counts = np.zeros(LIMBS * BITS, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 2048):
        m = _mix(h[None, i : i + 2048] ^ _SEEDS)
        bits = np.unpackbits(m[:LIMBS].astype(">u8").view(np.uint8).reshape(LIMBS, -1, 8), axis=2)
        counts += bits.sum(axis=1, dtype=np.int64).ravel()
        np.minimum(least, m[LIMBS:].min(axis=1), out=least)
    keys = _BAND_SEEDS
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mix((keys * _GOLDEN) ^ row)
    return np.packbits(counts * 2 > len(h)).tobytes(), keys


def _wide(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [wide_fingerprint(t, words) for t in batch.column("text").to_pylist()]
            flat = np.concatenate([k for _, k in got]).view(np.int64) if got else np.empty(0, dtype=np.int64)
            bands = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in got], pa.binary()), bands], names=["doc_id", "fp", "bands"])

    return common.trimmed(run)


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, the wide fingerprint's bytes and its band keys."""
    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_wide(words), f"doc_id {kind}, fp binary, bands array<bigint>")


def _majority(h: np.ndarray) -> int:
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return common.trimmed(run)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the fingerprint's 64 bits as a long."""
    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(words), f"doc_id {kind}, fp long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of the ``budget + 1`` blocks from the top bit down."""
    n = budget + 1
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return [(BITS - edges[i + 1], edges[i + 1] - edges[i]) for i in range(n)]


def _distance(limbs: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints at the given places."""
    return sum(np.bitwise_count(v[i] ^ v[j]).astype(np.int16) for v in limbs)


def _node_pairs(limbs: list[np.ndarray], roots: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits of fingerprints, given limb by limb, by walking tries' node pairs together.

    A node is a range of fingerprints that is sorted and agrees on all bits above its level; ``roots`` has a row
    (from, to, from, to) for each pair of top nodes: a node with itself, or with a later one. Each unordered pair of
    fingerprints is found once.
    """
    start = np.zeros((len(roots), 6), dtype=np.int64)
    start[:, :4], start[:, 5] = roots, BITS * len(limbs) - 1
    todo = [start]
    while todo:
        p = todo.pop()
        if len(p) > 200_000:  # bounded memory: depth first over slices
            half = len(p) // 2
            todo += [p[half:], p[:half]]
            continue
        na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        done = (na * nb <= LEAF) | (p[:, 5] < 0)
        leaf, p = p[done], p[~done]
        if len(leaf):
            sizes = (leaf[:, 1] - leaf[:, 0]) * (leaf[:, 3] - leaf[:, 2])
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            k, at = np.arange(sizes.sum()) - first, np.repeat(np.arange(len(leaf)), sizes)
            width = (leaf[:, 3] - leaf[:, 2])[at]
            i, j = leaf[at, 0] + k // width, leaf[at, 2] + k % width
            ok = (_distance(limbs, i, j) <= budget) & (i < j)
            if ok.any():
                yield i[ok], j[ok]
        if not len(p):
            continue
        level = int(p[0, 5])  # that of all rows
        v, bit = limbs[len(limbs) - 1 - level // BITS], np.uint64(level % BITS)
        mid_a, mid_b = _split(v, p[:, 0], p[:, 1], bit), _split(v, p[:, 2], p[:, 3], bit)
        children = []
        for x in (0, 1):
            for y in (0, 1):
                c = np.empty_like(p)
                c[:, 0], c[:, 1] = (p[:, 0], mid_a) if x == 0 else (mid_a, p[:, 1])
                c[:, 2], c[:, 3] = (p[:, 2], mid_b) if y == 0 else (mid_b, p[:, 3])
                c[:, 4], c[:, 5] = p[:, 4] + (x != y), p[:, 5] - 1
                # of two mirrored pairs the one whose first node comes first
                live = (c[:, 0] < c[:, 1]) & (c[:, 2] < c[:, 3]) & (c[:, 4] <= budget) & (c[:, 0] <= c[:, 2])
                children.append(c[live])
        todo.append(np.concatenate(children))


def _split(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the given bit turns from 0 to 1 in each range of a sorted array (all higher bits are equal there)."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        up = ((v[np.minimum(mid, len(v) - 1)] >> bit) & one) == 0
        lo = np.where(open_ & up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


class Forest:
    """Union-find over positions; the links that joined two trees are its edges."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join all pairs at once: hook larger roots under smaller ones until every pair agrees."""
        p = self.parent
        while len(i):
            ri, rj = _roots(p, i), _roots(p, j)
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            if len(i):
                np.minimum.at(p, np.maximum(ri, rj), np.minimum(ri, rj))

    def roots(self) -> np.ndarray:
        return _roots(self.parent, np.arange(len(self.parent)))


def _roots(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = p[x]
    while True:
        up = p[r]
        if (up == r).all():
            return r
        r = up


def _by_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], of, chunk: int) -> Iterator[pa.RecordBatch]:
    """``of`` applied to tables of whole groups, of about ``chunk`` rows or one group; rows come sorted by ``columns``."""
    held, rows = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= chunk:  # up to the last group, which may go on in the next batch
            table = pa.Table.from_batches(held)
            last = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
            cut = len(table) - int(np.argmax((last[::-1] != last[-1]).any(axis=1))) if (last != last[-1]).any() else 0
            if cut:
                yield of(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), len(table) - cut
    if rows:
        yield of(pa.Table.from_batches(held))


def _group_links(budget: int, chunk: int = 200_000):
    """Spanning links of the groups in a partition that is sorted by group, side and fingerprint."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(table: pa.Table) -> pa.RecordBatch:
        fp = table.column("fp").to_numpy().view(np.uint64)
        keys = np.stack([table.column(c).to_numpy() for c in ("r", "block", "low", "pair", "side")], axis=1).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        nodes, ends = keys[edge], np.append(edge[1:], len(fp))
        alone = nodes[:, 3] == 0
        roots = [np.stack([edge[alone], ends[alone]] * 2, axis=1)]
        first = np.flatnonzero(~alone[:-1] & (nodes[:-1, 4] == 0) & (nodes[1:, 4] == 1) & (nodes[:-1, :4] == nodes[1:, :4]).all(axis=1)) if len(nodes) > 1 else np.array([], dtype=np.int64)
        roots.append(np.stack([edge[first], ends[first], edge[first + 1], ends[first + 1]], axis=1) if len(first) else np.empty((0, 4), dtype=np.int64))
        forest = Forest(len(fp))
        for i, j in _node_pairs([fp], np.concatenate(roots), budget):
            forest.add(i, j)
        root = forest.roots()
        tied = root != np.arange(len(fp))
        return pa.record_batch([pa.array(fp[tied].view(np.int64)), pa.array(fp[root[tied]].view(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_groups(batches, ("r", "block", "low", "pair"), of, chunk)

    return common.trimmed(run)


def _middle(limbs: list[np.ndarray], rows: np.ndarray) -> int:
    """Of some fingerprints the one nearest to the majority of each bit."""
    counts = np.zeros(BITS * len(limbs), np.int64)
    for k in range(0, len(rows), 1 << 14):
        part = np.stack([v[rows[k : k + (1 << 14)]] for v in limbs], axis=1).astype(">u8")
        counts += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    centre = np.packbits(counts * 2 > len(rows)).view(">u8").astype(np.uint64)
    return int(rows[sum(np.bitwise_count(v[rows] ^ c).astype(np.int16) for v, c in zip(limbs, centre)).argmin()])


def _tie_dense(limbs: list[np.ndarray], rest: np.ndarray, budget: int, walk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that tie rows of a large group to pivots; rows within ``TIGHT`` bits of one are taken out of ``walk``.

    Rows that tight are surely one component by way of the pivot. Another row can only be within the budget of one of them from at
    most ``TIGHT`` bits more away from the pivot; it is held against all of them, and paired with the nearest and the pivot.
    """
    while len(rest) > PIVOT_OVER:
        pivot = _middle(limbs, rest)
        d = _distance(limbs, rest, pivot)
        near, far, rest = rest[d <= TIGHT], (d > TIGHT) & (d <= TIGHT + budget), rest[d > TIGHT]
        between = rest[far[d > TIGHT]]
        yield near, np.full(len(near), pivot)
        close = between[_distance(limbs, between, pivot) <= budget]
        yield close, np.full(len(close), pivot)
        walk[near] = False
        step = max(1, (1 << 22) // len(near))
        for k in range(0, len(between), step):
            some = between[k : k + step]
            each = _distance(limbs, some[:, None], near[None, :])
            for _ in range(min(NEAREST, len(near))):
                best = each.argmin(axis=1)
                at = np.arange(len(some))
                ok = each[at, best] <= budget
                yield some[ok], near[best[ok]]
                each[at, best] = np.iinfo(np.int16).max
        if len(near) < 2 + len(rest) // PIVOTS:  # not dense: the walk prunes
            return


def _nearest_forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs (i, j) that make a spanning forest of least distances: each tree takes its nearest pair, until none is left."""
    order = np.lexsort((j, i, d))
    forest, taken, left = Forest(n), [], order
    while len(left):
        root = forest.roots()
        left = left[root[i[left]] != root[j[left]]]
        if not len(left):
            break
        # ``left`` is in order of distance: the first pair of each tree is its nearest
        first = np.unique(np.concatenate([left[np.unique(root[x[left]], return_index=True)[1]] for x in (i, j)]))
        taken.append(first)
        forest.add(i[first], j[first])
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _both_ends(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return i[i != j], j[i != j]


def _similar_links(budget: int, chunk: int = 100_000):
    """Pairs that span the groups in a partition of wide fingerprints that is sorted by group and fingerprint, nearest first."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def of(table: pa.Table) -> pa.RecordBatch:
        fp = table.column("fp").to_pylist()
        wide = np.frombuffer(b"".join(fp), dtype=">u8").reshape(-1, LIMBS).astype(np.uint64)
        limbs = [np.ascontiguousarray(wide[:, k]) for k in range(LIMBS)]
        keys = np.stack([table.column(c).to_numpy() for c in ("band", "low", "high")], axis=1)
        edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        ends = np.append(edge[1:], len(fp))
        pairs, tied, walk = [], [], np.ones(len(fp), dtype=bool)
        walk[edge[ends - edge == 1]] = False
        for lo, hi in zip(edge, ends):
            if hi - lo > PIVOT_OVER:
                tied += _tie_dense(limbs, np.arange(lo, hi), budget, walk)
        at = np.flatnonzero(walk)
        if len(at):
            left = [v[at] for v in limbs]
            group = np.repeat(np.arange(len(edge)), ends - edge)[at]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            roots = np.stack([first, np.append(first[1:], len(at))] * 2, axis=1)
            pairs += [(at[i], at[j]) for i, j in _node_pairs(left, roots, budget)]
        i, j = _both_ends(pairs)
        some = _nearest_forest(len(fp), i, j, _distance(limbs, i, j)) if len(i) else i
        x, y = _both_ends([(i[some], j[some]), *tied])
        ordered = sorted({(min(fp[a], fp[b]), max(fp[a], fp[b])) for a, b in zip(x, y)})
        return pa.record_batch([pa.array([x for x, _ in ordered], pa.binary()), pa.array([y for _, y in ordered], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_groups(batches, ("band", "low", "high"), of, chunk)

    return common.trimmed(run)


def similarity_at_least(a: str | None, b: str | None, words: int, part: int, of: int) -> bool:
    """Have the texts' distinct shingles a Jaccard similarity of ``part`` / ``of`` or more? Texts without a word are equal."""
    x, y = (np.unique(_shingles(t, words)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return of * both >= part * (len(x) + len(y) - both)


def _checked(words: int, part: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array([similarity_at_least(x, y, words, part, of) for x, y in texts], pa.bool_()))

    return common.trimmed(run)


def checked_links(candidates: DataFrame, marked: DataFrame, docs: DataFrame, words: int = 5) -> DataFrame:
    """Of the candidate pairs (a, b) of wide fingerprints those whose texts have a similarity of ``LEAST`` or more.

    ``marked``: (doc_id with the text's hashes h and i, fp). Only texts that a pair needs are moved: a Bloom filter of bounded size
    keeps the others out of the shuffle, and the join on 128 bits of the text's hash is exact.
    """
    spark = docs.sparkSession
    base = common.run_dir(spark, "checked-links")
    candidates = common.stored(candidates.distinct(), f"{base}/candidates")
    ends = candidates.select(F.col("a").alias("fp")).unionByName(candidates.select(F.col("b").alias("fp"))).distinct()
    named = marked.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id.h", "doc_id.i")).alias("t")).select("fp", "t.h", "t.i")
    named = common.stored(named, f"{base}/named")
    held = common.bloom_filter(named.select("h"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(common.bloom_has(held.value, batch.column("h").to_numpy().view(np.uint64))))

    rows = docs.select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("i"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(wanted, "h long, i long, text string").groupBy("h", "i").agg(F.first("text").alias("text"))
    texts = common.stored(named.join(rows, ["h", "i"]).select("fp", "text"), f"{base}/texts")
    one = candidates.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_checked(words, *LEAST), "a binary, b binary")


def similar_links(distinct: DataFrame, budget: int = WIDE_BUDGET, split_over: int = SPLIT_OVER) -> DataFrame:
    """Candidate pairs (a, b) of distinct wide fingerprints (columns fp, bands): a spanning forest of each group's nearest pairs.

    A group over ``split_over`` is cut into parts by a hash, and dealt out by pairs of parts.
    """
    rows = distinct.select("fp", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").count().where(F.col("count") > split_over)
    sizes = common.stored(sizes, common.run_dir(distinct.sparkSession, "trie-heavy"))
    parts = F.coalesce(F.ceil(F.col("count") / split_over).cast("int"), F.lit(1))
    dealt = rows.join(sizes, "band", "left").select(
        "fp", "band", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    ).select("fp", "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    group = ["band", "low", "high"]
    return dealt.repartition(*group).sortWithinPartitions(*group, "fp").mapInArrow(_similar_links(budget), "a binary, b binary")


def links(distinct: DataFrame, budget: int = 2, split_over: int = SPLIT_OVER) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, long) whose components are those of all links."""
    if budget > 2:
        raise ValueError("groups are dealt out for budgets of up to 2 bits")
    spark = distinct.sparkSession
    rows = None
    for r, (shift, width) in enumerate(blocks(budget)):
        block = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        part = distinct.select("fp", F.lit(r).alias("r"), F.lit(shift).alias("shift"), block.alias("block"))
        rows = part if rows is None else rows.unionByName(part)
    rows = common.stored(rows, common.run_dir(spark, "trie"))
    sizes = rows.groupBy("r", "block").count().where("count > 1")
    # groups of one have no link; of the others the large are dealt out by node pairs further down
    rows = rows.join(sizes, ["r", "block"]).withColumn(
        "width", F.when(F.col("count") > split_over, F.least(F.lit(30), F.ceil(F.log2(F.col("count") / split_over)).cast("int") + 3)).otherwise(F.lit(0))
    )
    s = F.col("shift")
    turned = F.when(s == 0, F.col("fp")).otherwise(F.expr("shiftrightunsigned(fp, shift) | shiftleft(fp, 64 - shift)"))
    top = F.when(F.col("width") == 0, F.lit(0)).otherwise(F.expr("cast(shiftrightunsigned(__turned, 64 - width) AS int)"))
    flips = F.expr(
        "CASE WHEN width = 0 THEN array(0) ELSE filter(flatten(array(array(0), transform(sequence(0, width - 1), i -> shiftleft(1, i)), "
        "flatten(transform(sequence(0, width - 1), i -> transform(sequence(0, width - 1), j -> CASE WHEN i < j THEN shiftleft(1, i) | shiftleft(1, j) END))))), x -> x IS NOT NULL) END"
        if budget >= 2 else "CASE WHEN width = 0 THEN array(0) ELSE concat(array(0), transform(sequence(0, width - 1), i -> shiftleft(1, i))) END"
    )
    low = F.least(F.col("top"), F.expr("top ^ flip"))
    dealt = rows.withColumn("__turned", turned).withColumn("top", top).withColumn("flip", F.explode(flips)).select(
        "fp", "r", "block", low.alias("low"), F.col("flip").alias("pair"), (F.col("top") != low).cast("int").alias("side")
    )
    group = ["r", "block", "low", "pair"]
    return dealt.repartition(*group).sortWithinPartitions(*group, "side", F.expr("fp < 0"), "fp").mapInArrow(_group_links(budget), "a long, b long")


def _groups(marked: DataFrame, value: Column, tied_by: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each distinct fingerprint of ``marked``: fp, n (its rows) and ``least``, the least ``value`` of all rows that
    its links reach. ``tied_by`` makes the links of distinct fingerprints."""
    spark = marked.sparkSession
    base = common.run_dir(spark, "simhash-groups")
    bands = [F.min("bands").alias("bands")] if "bands" in marked.columns else []
    own = common.stored(marked.groupBy("fp").agg(F.min(value).alias("least"), F.count(F.lit(1)).alias("n"), *bands), f"{base}/own")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")  # rows of two numbers
    try:
        found = components(tied_by(own))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    of = own.join(found, own["fp"] == found["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    of = common.stored(of, f"{base}/of")
    tied = common.stored(of.groupBy("root").agg(F.min("least").alias("__least"), F.count(F.lit(1)).alias("__m")), f"{base}/tied")
    heavy = tied.where(F.col("__m") > F.lit(of.count() // common.HEAVY)).select("root", "__least")
    return common.spread_join(of, tied.select("root", "__least"), ["root"], heavy, ["fp"]).select("fp", "n", F.col("__least").alias("least"))


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) of each row."""
    spark = docs.sparkSession
    marked = common.stored(fingerprints(docs, words), common.run_dir(spark, "simhash"))
    named = common.stored(_groups(marked, F.col("doc_id"), lambda own: links(own.select("fp"), budget)), common.run_dir(spark, "simhash-named"))
    heavy = named.where(F.col("n") > F.lit(marked.count() // common.HEAVY)).select("fp", "least")
    out = common.spread_join(marked, named.select("fp", "least"), ["fp"], heavy, ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, budget: int = WIDE_BUDGET) -> DataFrame:
    """``docs`` with one row of each group of near duplicates (links of a checked similarity of 0.8): that with the smallest doc_id.

    A row without an id is kept only if its whole group has none; of rows that share the smallest id, that with the
    smallest hash of its text, and of rows equal in both one. Rows are told apart by id and 128 bits of a hash of the text.
    """
    spark = docs.sparkSession
    base = common.run_dir(spark, "one-of-each")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("i"))
    marked = common.stored(wide_fingerprints(docs.select(own.alias("doc_id"), "text"), words), f"{base}/marked")
    kept = _groups(marked, F.col("doc_id"), lambda own: checked_links(similar_links(own, budget), marked, docs, words)).select("least").distinct()
    kept = common.stored(kept.select("least.*").withColumnsRenamed({c: f"__{c}" for c in ("none", "doc_id", "h", "i")}), f"{base}/kept")
    same = docs["doc_id"].eqNullSafe(kept["__doc_id"]) & (F.xxhash64("text") == kept["__h"]) & (F.xxhash64(F.lit(1), "text") == kept["__i"])
    out = docs.join(kept, same, "left_semi")
    # rows equal in id and text are rare, so what they cost is only paid where there are some
    twice = marked.groupBy("doc_id").count().where("count > 1").select("doc_id.*").withColumnsRenamed({c: f"__{c}" for c in ("none", "doc_id", "h", "i")})
    twice = common.stored(twice.join(kept.select("__h", "__i"), ["__h", "__i"], "left_semi"), f"{base}/twice")
    if twice.isEmpty():
        return out
    again = docs["doc_id"].eqNullSafe(twice["__doc_id"]) & (F.xxhash64("text") == twice["__h"]) & (F.xxhash64(F.lit(1), "text") == twice["__i"])
    return out.join(twice, again, "left_anti").unionByName(out.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))
