"""Operators on ordered rows: dedupe by order, running labels, carries, packing and slicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order`` (``dropDuplicates`` would take any)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)


def position(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def padded(n: Column, width: int = 2) -> Column:
    """At least ``width`` digits; longer numbers are kept whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0"))


def ordinal_suffix(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``key``, and ``key#1``, ``key#2`` for its repeats."""
    k = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn(name, F.when(k == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), k.cast("string"))))


def sub_letter(df: DataFrame, by: list[str], label: str, order: list[str], name: str) -> DataFrame:
    """``1``, then ``1b``, ``1c`` for repeats of a label."""
    k = F.row_number().over(W.partitionBy(*by, label).orderBy(*order))
    return df.withColumn(name, F.when(k == 1, F.col(label)).otherwise(F.concat(F.col(label), F.char(F.lit(96) + k))))


def carry(df: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The last value that isn't null, up to this row."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


#: Positions in one split of a scan.
SPAN = 1 << 16


def scan(df: DataFrame, by: list[str], at: str, counts: dict[str, Column] | None = None, last: dict[str, Column] | None = None, span: int = SPAN) -> DataFrame:
    """``df`` with running values over the order of ``at`` (a position from 0 or 1): of each of ``counts`` how many rows up to this one
    hold it, of each of ``last`` its last value up to this row that isn't null.

    A prefix scan over splits of ``span`` positions: each split is scanned by itself, and takes over what a small table (a row a
    split) has of the splits before. So no task has a whole group, however long its order is. Keys of ``by`` are not null.
    """
    counts, last = counts or {}, last or {}
    rows = df.withColumn("__split", F.floor(F.col(at) / span))
    rows = rows.withColumns({f"__c_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in counts.items()} | {f"__v_{n}": c for n, c in last.items()})
    sums = [F.sum(f"__c_{n}").alias(f"__c_{n}") for n in counts]
    ends = [F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(at))).alias(f"__v_{n}") for n in last]
    before = W.partitionBy(*by).orderBy("__split").rowsBetween(W.unboundedPreceding, -1)
    taken = rows.groupBy(*by, "__split").agg(*sums, *ends).select(
        *by, "__split", *(F.coalesce(F.sum(f"__c_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in counts), *(F.last(f"__v_{n}", ignorenulls=True).over(before).alias(f"__b_{n}") for n in last)
    )
    own = W.partitionBy(*by, "__split").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(f"__c_{n}").over(own) for n in counts} | {n: F.last(f"__v_{n}", ignorenulls=True).over(own) for n in last})
    out = rows.join(taken, [*by, "__split"])
    return out.select(*(c for c in df.columns if c not in counts and c not in last), *((F.col(n) + F.col(f"__b_{n}")).alias(n) for n in counts), *(F.coalesce(n, f"__b_{n}").alias(n) for n in last))


def clusters(df: DataFrame, by: list[str], order: list[str], size: int, name: str) -> DataFrame:
    """Number of each run of ``size`` rows, from 0."""
    return df.withColumn(name, F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / size))


def expected_next(numbers: Column, start: int = 1) -> Column:
    """Of an array of marker numbers, those accepted: each must be the one after the last accepted. Only how far they go is folded."""
    last = F.aggregate(numbers, F.lit(start).cast("long"), lambda due, x: F.when(x.cast("long") == due, due + 1).otherwise(due))
    return F.when(last > start, F.sequence(F.lit(start).cast("long"), last - 1)).otherwise(F.array().cast("array<bigint>"))


def packed(counts: Column, target: int = 533, least: int = 106) -> Column:
    """Greedy packing of paragraphs' word counts: array of struct(first, last, words), paragraphs from 0.

    A paragraph that would pass ``target`` starts a new chunk if the open one has ``least`` words; an open chunk that
    reaches ``target`` by another paragraph is closed. Empty paragraphs are skipped.
    """
    kind = "struct<first:int,last:int,words:int>"
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("words"))
    now = lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last"), a["words"].alias("words"))

    def state(done, first, last, words):
        return F.struct(done.alias("done"), first.cast("int").alias("first"), last.cast("int").alias("last"), words.cast("int").alias("words"))

    def step(a, x):
        n, i = x["n"], x["i"]
        flush = (a["words"] > 0) & (a["words"] + n > target) & (a["words"] >= least)
        first = F.when(a["words"] > 0, a["first"]).otherwise(i)
        full = a["words"] + n >= target
        grown = F.struct(first.cast("int").alias("first"), i.cast("int").alias("last"), (a["words"] + n).cast("int").alias("words"))
        return (
            F.when(n <= 0, state(a["done"], a["first"], a["last"], a["words"]))
            .when(flush, state(F.concat(a["done"], F.array(now(a))), i, i, n))
            .when(full, state(F.concat(a["done"], F.array(grown)), F.lit(-1), F.lit(-1), F.lit(0)))
            .otherwise(state(a["done"], first, i, a["words"] + n))
        )

    indexed = F.transform(counts, lambda n, i: F.struct(n.cast("int").alias("n"), i.cast("int").alias("i")))
    return F.aggregate(indexed, empty, step, lambda a: F.when(a["words"] > 0, F.concat(a["done"], F.array(now(a)))).otherwise(a["done"]))


def contained(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points inside spans, as an equi-join on buckets of ``width``: a span is in every bucket that it touches."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(s, "__b").where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("__b")


def owner(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Each point with the columns of the span of the greatest ``lo`` at or below it, if that span's ``hi`` isn't below it; null else.

    An as-of join: points and spans are one table in order of place, a span before points of its place, and each point takes the last
    span's values by a prefix scan over ranges of ``width`` places. Each row is shuffled once, however long a span is, and spans may
    nest. Of spans that start at one place the one with the greatest ``hi``, then values, counts. Points without a place have no owner.
    """
    names = [c for c in spans.columns if c not in points.columns]
    span = F.struct(hi, *(c for c in spans.columns if c != hi))
    starts = spans.where(F.col(lo).isNotNull()).groupBy(F.col(lo).cast("double").alias("__at")).agg(F.max(span).alias("__span"))
    both = points.select(F.col(at).cast("double").alias("__at"), F.struct(*points.columns).alias("__point"), F.lit(None).cast(starts.schema["__span"].dataType).alias("__span"))
    both = both.unionByName(starts.select("__at", F.lit(None).cast(both.schema["__point"].dataType).alias("__point"), "__span")).where("__at IS NOT NULL")
    # a place's own rows in order: the span first
    both = both.withColumns({"__one": F.lit(0), "__k": F.col("__at") * 2 + F.col("__point").isNotNull().cast("int")})
    found = scan(both, ["__one"], "__k", last={"__s": F.col("__span")}, span=2 * width).where("__point IS NOT NULL")
    inside = F.col(f"__s.{hi}") >= F.col("__at")
    out = found.select("__point.*", *(F.when(inside, F.col(f"__s.{c}")).alias(c) for c in names))
    nowhere = points.where(F.col(at).isNull()).select(*points.columns, *(F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in names))
    return out.unionByName(nowhere)


def joined_text(df: DataFrame, by: list[str], order: str, text: str, after: str | None = None) -> DataFrame:
    """(by, text): pieces in order, with each piece's own separator or one space between."""
    parts = F.sort_array(F.collect_list(F.struct(order, text, *([after] if after else []))))
    rows = df.groupBy(*by).agg(parts.alias("__p"))
    if after:
        whole = F.array_join(F.transform("__p", lambda x: F.concat(x[text], F.coalesce(x[after], F.lit("")))), "")
    else:
        whole = F.array_join(F.transform("__p", lambda x: x[text]), " ")
    return rows.select(*by, F.trim(whole).alias("text"))


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value): the most frequent value; of equals the greatest."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*by).agg(F.max_by(value, F.struct("__n", value)).alias(value))


def bridged(df: DataFrame, rules: DataFrame, ref: str, order: list[str]) -> DataFrame:
    """``df`` with ``mapped``: the first rule's target for ``ref``, else ``ref`` itself. rules: (from_ref, to_ref, ...)."""
    first = rules.groupBy("from_ref").agg(F.min_by("to_ref", F.struct(*order)).alias("__to"))
    return df.join(first, df[ref] == first["from_ref"], "left").select(*df.columns, F.coalesce("__to", ref).alias("mapped"))
