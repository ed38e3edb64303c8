"""Exact cosine top-k by blocks: items and queries are dealt into blocks, a task multiplies one block of each as matrices and gives
each query's first ``k`` of the block, so that the rows that are shuffled are few and a task's memory has a bound.

All pairs are scored, as an exact search of vectors that no index can part must; what a pair costs is some nanoseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Items and queries of a block.
ITEMS = QUERIES = 1 << 14
#: Scores that a task holds at once.
SCORES = 1 << 21
#: What rounding to 6 places may hide.
SLACK = 2e-6


def _vectors(column: pa.ChunkedArray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows, unit vectors) for each number of dimensions; rows without a whole vector are in none."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    n = len(a)
    if n == 0:
        return []
    size = np.diff(a.offsets.to_numpy())
    if a.null_count == 0 and (size == size[0]).all() and a.flatten().null_count == 0:
        found = [(int(size[0]), np.arange(n), a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))]
    else:
        by: dict[int, tuple[list, list]] = {}
        for k, x in enumerate(a.to_pylist()):
            if x is not None and None not in x:
                rows, vectors = by.setdefault(len(x), ([], []))
                rows.append(k)
                vectors.append(x)
        found = [(d, np.array(r), np.array(v, dtype=np.float64).reshape(len(r), d)) for d, (r, v) in by.items()]
    out = []
    for d, rows, v in found:
        length = np.sqrt((v * v).sum(1, keepdims=True))
        out.append((d, rows, v / np.where(length == 0, 1.0, length)))
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero by the number's decimal form, as Spark does."""
    up = np.abs(x) * 1e6
    whole = np.floor(up + 0.5)
    out = np.copysign(whole / 1e6, x)
    for k in np.flatnonzero(np.abs(up - np.floor(up) - 0.5) < 1e-6):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out + 0.0


def _first(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of the ``k`` greatest of each row; of equal ones the first columns. inf and -inf stay."""
    n = scores.shape[1]
    least = np.full(len(scores), -np.inf)
    if n // 64 >= k:
        # k columns of a row are at or above the k-th of its columns' maxima in groups
        most = scores[:, : n // 64 * 64].reshape(len(scores), -1, 64).max(2)
        least = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] - SLACK
    rows, columns = np.nonzero(scores >= least[:, None])
    value = scores[rows, columns]
    finite = np.isfinite(value)
    value[finite] = rounded(value[finite])
    order = np.lexsort((columns, -value, rows))
    rows, columns, value = rows[order], columns[order], value[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k], value[place < k]


def _block(queries: pa.Table, items: pa.Table, k: int, group: str | None, kept: list[str]) -> Iterator[pa.Table]:
    items = items.sort_by([(c, "ascending") for c in ([group] if group else []) + ["id"]])
    ends = [0, items.num_rows]
    if group:
        code = items[group].combine_chunks().dictionary_encode("encode")
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        ends = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), items.num_rows]
    asked = {d: (rows, v) for d, rows, v in _vectors(queries["asked"])}
    whole = _vectors(items["vector"])
    for lo, hi in zip(ends, ends[1:]):
        step = max(1, SCORES // max(1, hi - lo))
        for at in range(0, queries.num_rows, step):
            s = np.full((min(step, queries.num_rows - at), hi - lo), -np.inf)  # no score
            for d, rows, v in whole:
                here = (rows >= lo) & (rows < hi)
                mine, q = asked.get(d, (np.array([], dtype=int), None))
                there = (mine >= at) & (mine < at + len(s))
                if here.any() and there.any():
                    p = q[there] @ v[here].T
                    s[np.ix_(mine[there] - at, rows[here] - lo)] = np.where(np.isnan(p), np.inf, p)
            row, column, score = _first(s, k)
            said = pa.array(np.where(np.isposinf(score), np.nan, score), mask=np.isneginf(score))
            one = {"query_id": queries["asker"].take(pa.array(row + at))} | {c: items[c].take(pa.array(column + lo)) for c in kept}
            yield pa.table(one | {"score": said})


def scored(queries: DataFrame, items: DataFrame, k: int, group: str | None = None, keep: list[str] = [], by: list[str] = [], n_items: int | None = None) -> DataFrame:  # noqa: B006
    """(query_id, id, *keep, score): of each block of items each query's first ``k`` (of each ``group``), which hold its first ``k`` of all.

    queries: (query_id, vector, *by), items: (id, vector, group, *keep, *by). With ``by``, a query meets the items of its own keys only;
    ``n_items`` is then the number of blocks that the items of one key need.
    Scores are rounded to 6 places, ties go by id; a pair without a score (a null, or other dimensions) comes after all.
    """
    kept = list(dict.fromkeys(["id", *([group] if group else []), *keep]))
    blocks = lambda df, most: max(1, -(-df.count() // most))
    n_items, n_queries = n_items or blocks(items, ITEMS), blocks(queries, QUERIES)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # columns of names of their own: both sides may come from one table, and cogroup tells its columns by their origin
    q = queries.select(F.col("query_id"), F.col("vector").alias("asked"), *(F.col(c).alias(f"__{c}") for c in by), part("query_id", n_queries).alias("__q")).withColumn("__i", each(n_items)).withColumnRenamed("query_id", "asker")
    v = items.select(*kept, "vector", *(c for c in by if c not in kept), part("id", n_items).alias("__i")).withColumn("__q", each(n_queries))
    fields = [queries.schema["query_id"], *(items.schema[c] for c in kept), StructField("score", DoubleType())]
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    none = to_arrow_schema(schema).empty_table()

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_block(left, right, k, group, kept)) if left.num_rows and right.num_rows else []
        return pa.concat_tables(found) if found else none

    return q.groupBy(*(f"__{c}" for c in by), "__i", "__q").cogroup(v.groupBy(*by, "__i", "__q")).applyInArrow(block, schema)
