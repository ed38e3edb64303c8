"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier one (by doc_id, then place in the document) is equal, or is within ``edits`` word edits of it
(insert, delete or replace; one by default; both of at least ``MIN_WORDS`` words for each, so that at most a fifth differs). The
edit unit is the word: a line has as many deletion variants as words, not as characters.

Two lines within one edit share a variant: equal residuals after deleting the word at the same place, or one line's
residual is the other line. All variants of a line are emitted as hashed keys and joined; a group's members are tied to
its earliest one only, which decides as much as all pairs would: whoever has an earlier neighbour in the group has the
earliest as one. Tied pairs are then verified on their texts.

For more than one edit, k, a variant is what is left after up to k deletions together with k places in it, among them those of the
deleted words. Two lines within k edits share such a variant: what both keep, and at each place as many as the line that has more words
there. Lines that share one are within k edits, so here too the earliest of a group decides. A line of n words has about
(2n)^k / k! variants.

Only lines that can have a neighbour emit variants. With one edit between two lines, the half of the shorter line that
the edit isn't in is whole in both, so each line gives hashed keys of its halves, and lines whose keys no different
line shares are left out. That set travels as a bit table of fixed size: lines that pass it by chance only cost time.
Where more than a quarter of the table would be set, it would keep little out; the set is joined by line then.

A line is known by 128 bits of a hash, and so is a variant.

Defined results: words are runs without white space; lines without words (and null or empty texts) are no lines here
and stay in the text; null doc_ids come first; rows that share a doc_id, or have none, are told apart by 64 bits of a hash of the
text, and come in that hash's order; rows equal in doc_id and text have the same places, so they get the same result; an empty table gives no rows; other columns are ignored by
``line_duplicates`` and kept by ``without_duplicates``; texts are read whole, lines of any length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

MIN_WORDS = 5
#: Words of 64 bits in the bit table of candidate lines: 8 MB, whatever the input.
TABLE_WORDS = 1 << 20
#: Bases of the two polynomial hashes of variants, odd so that they have inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _salt(n: int) -> np.uint64:
    """Tells residuals of different lengths apart."""
    return np.uint64(n * 0xD6E8FEB86659FD93 & (1 << 64) - 1)


def digest(line: str) -> bytes:
    """128 bits that stand for a line (without white space at its ends)."""
    return xxhash.xxh3_128_digest(line.strip().encode("utf-8", "surrogatepass"))


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last 64 bits of each digest, as signed numbers."""
    both = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def half_keys(words: list[str], min_words: int = MIN_WORDS) -> list[int]:
    """Keys of which two lines within one word edit share at least one.

    For each length that the shorter line of a pair may have (its own, or one less): the first half of so many words,
    and as many last words as the other half has.
    """
    out, n = [], len(words)
    for base in (n, n - 1):
        if base >= min_words:
            p = base // 2
            out.append(_key("<", base, words[:p]))
            out.append(_key(">", base, words[n - (base - p) :]))
    return out


def part_keys(words: list[str], edits: int, min_words: int) -> list[int]:
    """Keys of which two lines within ``edits`` word edits share at least one.

    The shorter line of a pair is cut in ``edits`` + 1 parts, of which one is whole in both, moved by at most ``edits`` places.
    """
    out, n = set(), len(words)
    for base in range(max(min_words, n - edits), n + 1):
        cuts = [base * i // (edits + 1) for i in range(edits + 2)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for move in range(-edits, edits + 1):
                if 0 <= a + move and b + move <= n:
                    out.add(_key(f"{i} of {edits} ", base, words[a + move : b + move]))
    return sorted(out)


def multi_variants(words: list[str], edits: int) -> set[tuple[int, int]]:
    """128-bit keys, in two halves, of what up to ``edits`` deletions leave, with ``edits`` places in it."""
    n, out = len(words), set()
    first, second = (h.view(np.uint64).tolist() for h in _halves([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in words]))
    for gone in range(min(edits, n) + 1):
        for places in combinations(range(n), gone):
            kept = [k for k in range(n) if k not in places]
            left = xxhash.xxh3_128(b"".join(struct.pack(">QQ", first[k], second[k]) for k in kept))
            at = [p - j for j, p in enumerate(places)]  # places among the words that are left
            for more in combinations_with_replacement(range(len(kept) + 1), edits - gone):
                h = left.copy()
                h.update(f"@{sorted([*at, *more])}".encode())
                out.add(struct.unpack(">qq", h.digest()))
    return out


def within(a: list[str], b: list[str], edits: int) -> bool:
    """Is the word edit distance at most ``edits``? By a band of the distance table."""
    if abs(len(a) - len(b)) > edits:
        return False
    far = edits + 1
    row = {j: j for j in range(min(edits, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            best = min(row.get(j, far), new.get(j - 1, far)) + 1
            new[j] = min(best, row.get(j - 1, far) + (x != b[j - 1])) if j else i
        row = new
    return row.get(len(b), far) <= edits


def _key(side: str, base: int, words: list[str]) -> int:
    v = xxhash.xxh64_intdigest(f"{side}{base} {' '.join(words)}".encode("utf-8", "surrogatepass"))
    return v - (1 << 64) if v >> 63 else v


def variants(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, second keys): the residual of deleting each word, and the line itself (place -1).

    Keys are polynomial hashes of word hashes modulo 2**64, so all residuals take one pass.
    """
    n = len(words)
    first, second = _halves([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in words])
    a, b = (_residuals(w.view(np.uint64), base) for w, base in zip((first, second), _BASES))
    return a, np.arange(-1, n, dtype=np.int32), b


def _residuals(w: np.ndarray, base: int) -> np.ndarray:
    n = len(w)
    powers = np.ones(n, dtype=np.uint64)
    powers[1:] = np.cumprod(np.full(max(n - 1, 0), np.uint64(base), dtype=np.uint64))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * powers, dtype=np.uint64)])
    whole = upto[-1:]  # as an array: its arithmetic wraps around silently
    residual = upto[:-1] + (whole - upto[1:]) * np.uint64(pow(base, -1, 1 << 64)) + _salt(n - 1)
    return np.concatenate([whole + _salt(n), residual]).view(np.int64)


def within_one(a: list[str], b: list[str]) -> bool:
    """Is the word edit distance at most one?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _scan(min_words: int, edits: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place, hs, keys = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for at, line in enumerate((text or "").split("\n")):
                    if words := line.split():
                        doc.append(k)
                        place.append(at)
                        hs.append(digest(line))
                        keys.append(half_keys(words, min_words) if edits == 1 else part_keys(words, edits, min_words))
            x, y = _halves(hs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(place, pa.int32()), pa.array(x), pa.array(y), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "line_no", "x", "y", "keys"]
            )

    return common.trimmed(run)


def _candidates(table: Broadcast | None, min_words: int):
    """The lines of at least ``min_words`` words that the bit table has; all such lines without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, dtype=np.uint64) if table else None
        for batch in batches:
            doc, place, hs, lines = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for at, line in enumerate((text or "").split("\n")):
                    if line and not line.isspace():
                        doc.append(k)
                        place.append(at)
                        hs.append(digest(line))
                        lines.append(line)
            x, y = _halves(hs)
            h = x.view(np.uint64)
            keep = np.arange(len(h)) if bits is None else np.flatnonzero((bits[(h >> np.uint64(6)) % np.uint64(len(bits))] >> (h & np.uint64(63))) & np.uint64(1))
            keep = np.array([i for i in keep.tolist() if len(lines[i].split()) >= min_words], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.array(doc, dtype=np.int64)[keep])), pa.array(np.array(place, dtype=np.int32)[keep]), pa.array(x[keep]), pa.array(y[keep]), pa.array([lines[i].strip() for i in keep], pa.string())],
                names=["doc_id", "line_no", "x", "y", "line"],
            )

    return common.trimmed(run)


def _variant_rows(batches: Iterator[pa.RecordBatch], most: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Variants of each line, in batches of bounded size however long the lines are."""
    for batch in batches:
        parts, rows, held = [], [], 0
        for k, line in enumerate(batch.column("line").to_pylist()):
            v, at, w = variants(line.split())
            for lo in range(0, len(v), most):
                parts.append((v[lo : lo + most], w[lo : lo + most], at[lo : lo + most]))
                rows.append(np.full(len(parts[-1][0]), k))
                held += len(rows[-1])
                if held >= most:
                    yield _variant_batch(batch, parts, rows)
                    parts, rows, held = [], [], 0
        if rows:
            yield _variant_batch(batch, parts, rows)


def _variant_batch(batch: pa.RecordBatch, parts: list, rows: list) -> pa.RecordBatch:
    row = pa.array(np.concatenate(rows))
    own = [batch.column(c).take(row) for c in ("x", "y", "doc_id", "line_no")]
    return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(p)) for p in zip(*parts)), *own], names=["v", "w", "at", "x", "y", "doc_id", "line_no"])


def _multi_variant_rows(edits: int):
    """All variants of each line for more than one edit, in batches of bounded size but for one line's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, line in enumerate(batch.column("line").to_pylist()):
                keys = np.array(sorted(multi_variants(line.split(), edits)), dtype=np.int64)
                own = [batch.column(c).take(pa.array(np.full(len(keys), k))) for c in ("x", "y", "doc_id", "line_no")]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *own], names=["v", "w", "x", "y", "doc_id", "line_no"])

    return common.trimmed(run)


def _verified(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("line").to_pylist(), batch.column("line2").to_pylist()
            yield batch.select(["x", "y", "first", "x2", "y2", "first2"]).filter(pa.array([within(x.split(), y.split(), edits) for x, y in zip(a, b)], pa.bool_()))

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("line").to_pylist(), batch.column("line2").to_pylist()
        yield batch.select(["x", "y", "first", "x2", "y2", "first2"]).filter(pa.array([within_one(x.split(), y.split()) for x, y in zip(a, b)], pa.bool_()))


def scan_lines(docs: DataFrame, min_words: int = MIN_WORDS, edits: int = 1) -> DataFrame:
    """Every line with a word: doc_id, line_no, the two halves x and y of its digest, and the keys of its halves; written
    once, read often."""
    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan(min_words, edits), f"doc_id {kind}, line_no int, x long, y long, keys array<long>")
    return common.stored(found, common.run_dir(docs.sparkSession, "lines"))


def _one_edit_ties(distinct: DataFrame, kind: str) -> DataFrame:
    """(x, y, x2, y2): lines that share a variant of one edit with the group's earliest."""
    # made anew for each use: cheaper than a table of them, as only lines with a neighbour are here
    rows = distinct.mapInArrow(_variant_rows, f"v long, w long, at int, x long, y long, doc_id {kind}, line_no int")
    group = rows.groupBy("v", "w", "at").agg(F.min(F.struct("doc_id", "line_no", "x", "y")).alias("m"), F.count(F.lit(1)).alias("n"))
    other = [F.col("m.x").alias("x2"), F.col("m.y").alias("y2")]
    one = group.where("at = -1").select("v", "w", *other)
    many = group.where("at >= 0 AND n > 1").select("v", "w", "at", *other)
    gaps, both = rows.where("at >= 0").select("v", "w", "at", "x", "y"), ["x", "y", "x2", "y2"]
    ties = gaps.join(many, ["v", "w", "at"]).select(*both).unionByName(gaps.join(one, ["v", "w"]).select(*both))
    return ties


def near_ties(docs: DataFrame, lines: DataFrame, min_words: int = MIN_WORDS, table_words: int = TABLE_WORDS, edits: int = 1) -> DataFrame:
    """Verified ties between different lines within ``edits`` word edits: x, y, first and x2, y2, first2 (a line's digest and
    the earliest place that it has)."""
    spark = docs.sparkSession
    base = common.run_dir(spark, "line-variants")
    keyed = lines.select("x", "y", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    shared = ends.where("a <> b OR c <> d").select("key")
    maybe = common.stored(keyed.join(shared, "key", "left_semi").groupBy("x", "y").count().select("x", "y"), f"{base}/maybe")
    # a place in the bit table for each of these lines
    spots = maybe.select(F.expr(f"shiftrightunsigned(x, 6) % {table_words}").alias("word"), F.expr("shiftleft(1L, cast(x & 63 AS int))").alias("bit"))
    filled = spots.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most table_words rows
    table = np.zeros(table_words, dtype=np.int64)
    table[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    roomy = int(np.bitwise_count(table.view(np.uint64)).sum()) <= 16 * table_words
    held = spark.sparkContext.broadcast(table.tobytes()) if roomy else None
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_candidates(held, min_words), f"doc_id {kind}, line_no int, x long, y long, line string")
    distinct = found.groupBy("x", "y").agg(F.min(F.struct("doc_id", "line_no")).alias("f"), F.first("line").alias("line"))
    if not roomy:
        distinct = distinct.join(maybe, ["x", "y"], "left_semi")
    distinct = common.stored(distinct.select("x", "y", "f.doc_id", "f.line_no", "line"), f"{base}/distinct")
    if edits > 1:
        rows = distinct.mapInArrow(_multi_variant_rows(edits), f"v long, w long, x long, y long, doc_id {kind}, line_no int")
        group = rows.groupBy("v", "w").agg(F.min(F.struct("doc_id", "line_no", "x", "y")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
        ties = rows.select("v", "w", "x", "y").join(group.select("v", "w", F.col("m.x").alias("x2"), F.col("m.y").alias("y2")), ["v", "w"]).select("x", "y", "x2", "y2")
    else:
        ties = _one_edit_ties(distinct, kind)
    ties = ties.where("x <> x2 OR y <> y2").distinct()
    text = distinct.select("x", "y", F.struct("doc_id", "line_no").alias("first"), "line")
    other = text.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("first").alias("first2"), F.col("line").alias("line2"))
    both = ties.join(text, ["x", "y"]).join(other, ["x2", "y2"]).select("x", "y", "first", "line", "x2", "y2", "first2", "line2")
    place = f"struct<doc_id: {kind}, line_no: int>"
    return both.mapInArrow(_verify if edits == 1 else _verified(edits), f"x long, y long, first {place}, x2 long, y2 long, first2 {place}")


def line_duplicates(docs: DataFrame, min_words: int | None = None, table_words: int = TABLE_WORDS, edits: int = 1) -> DataFrame:
    """For every line with a word: doc_id, line_no, ``kind`` (kept, exact, near), and the earlier line it repeats.

    Of a near line's earlier neighbours the earliest verified one is named. ``__row`` is the hash of the row's text, ``__x`` and
    ``__y`` are the line's digest.
    """
    if edits < 1:
        raise ValueError("one edit or more")
    min_words = MIN_WORDS * edits if min_words is None else max(min_words, edits + 1)
    # a row is its id and its text's hash: an id may be missing, or shared
    docs = docs.select(F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("row")).alias("doc_id"), "text")
    lines = scan_lines(docs, min_words, edits)
    ties = near_ties(docs, lines, min_words, table_words, edits)
    later = F.col("first") > F.col("first2")
    pick = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b)).alias(a)
    ends = ties.select(pick("x", "x2"), pick("y", "y2"), F.least("first", "first2").alias("of"))
    near = ends.groupBy("x", "y").agg(F.min("of").alias("near"))
    firsts = lines.groupBy("x", "y").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = common.stored(firsts.join(near, ["x", "y"], "left"), common.run_dir(docs.sparkSession, "line-firsts"))
    heavy = firsts.where(F.col("n") > F.lit(lines.count() // common.HEAVY)).drop("n")
    place = F.struct("doc_id", "line_no")
    known = common.spread_join(lines.select("doc_id", "line_no", "x", "y"), firsts.drop("n"), ["x", "y"], heavy, ["doc_id", "line_no"])
    kind = F.when(~place.eqNullSafe(F.col("first")), "exact").when(F.col("near").isNotNull(), "near").otherwise("kept")
    of = F.when(~place.eqNullSafe(F.col("first")), F.col("first")).otherwise(F.col("near"))
    return known.select("doc_id.doc_id", "line_no", kind.alias("kind"), of["doc_id"]["doc_id"].alias("of_doc_id"), of["line_no"].alias("of_line_no"), F.col("doc_id.row").alias("__row"), F.col("x").alias("__x"), F.col("y").alias("__y"))


_PAIR = struct.Struct(">qq")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        out = []
        for text, gone in zip(batch.column(at).to_pylist(), batch.column("__lines_gone").to_pylist()):
            if text is not None and gone:
                places: dict[int, set[bytes]] = {}
                for g in gone:
                    places.setdefault(g["line_no"], set()).add(_PAIR.pack(g["x"], g["y"]))
                # the digest tells apart rows that share a doc_id
                text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in places or digest(x) not in places[k])
            out.append(text)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).select([i for i, n in enumerate(batch.schema.names) if n != "__lines_gone"])


def without_duplicates(docs: DataFrame, min_words: int | None = None, edits: int = 1) -> DataFrame:
    """``docs`` without the lines that repeat earlier ones; ``n_chars``, if there, is counted again."""
    gone = line_duplicates(docs, min_words, edits=edits).where("kind <> 'kept'")
    # a list for each text: the dropped lines of one document
    gone = gone.groupBy("doc_id", "__row").agg(F.collect_set(F.struct("line_no", F.col("__x").alias("x"), F.col("__y").alias("y"))).alias("__gone"))
    gone = gone.toDF("__doc_of_gone", "__row_of_gone", "__lines_gone")
    same = docs["doc_id"].eqNullSafe(gone["__doc_of_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__row_of_gone"])
    joined = docs.join(gone, same, "left").select(*[docs[f"`{c}`"] for c in docs.columns], "__lines_gone")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = joined.mapInArrow(common.trimmed(_cut), fields)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
