"""Sinks: what the engine writes besides its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.vectors import uuid5


def jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a fixed order with a fixed field order: two runs give the same bytes, file by file."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def unsafe_ids(docs: DataFrame, key: str, safe: str) -> DataFrame:
    """Sorted distinct ids of documents that may not be shared."""
    return docs.where(~F.col(safe)).select(key).distinct().orderBy(key)


def publishable(docs: DataFrame, safe: str) -> DataFrame:
    """Documents whose flag is true; null isn't."""
    return docs.where(F.col(safe) == F.lit(True))


def vector_points(rows: DataFrame, key: str, vector: str, namespace: str, payload: list[str]) -> DataFrame:
    """(id, vector, payload): one point for each key, with a stable id; written with overwrite, no stale point stays."""
    one = rows.groupBy(key).agg(F.max_by(F.struct(vector, *payload), F.struct(*payload)).alias("r"))
    return one.select(uuid5(namespace, F.col(key)).alias("id"), F.col(f"r.{vector}").alias("vector"), F.struct(key, *(F.col(f"r.{p}").alias(p) for p in payload)).alias("payload"))


def patched(base: DataFrame, tags: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` set where ``tags`` has a value for the key; nothing else changes."""
    new = tags.select(key, F.col(column).alias("__new")).where(F.col("__new").isNotNull())
    return base.join(new, key, "left").select(*(F.coalesce("__new", c).alias(c) if c == column else F.col(c) for c in base.columns))


def embed_text(lemma: Column, translit: Column, gloss: Column, pos: Column, domain: Column, ln: Column, most: int = 6000) -> Column:
    """``lemma (translit) : gloss | pos .. | domain .. | LN ..`` of the parts that there are."""
    some = lambda c, shown: F.when(F.trim(c) != "", shown)
    head = F.concat_ws(" ", some(lemma, lemma), some(translit, F.concat(F.lit("("), translit, F.lit(")"))), some(gloss, F.concat(F.lit(": "), gloss)))
    return F.substring(F.concat_ws(" | ", some(head, head), some(pos, F.concat(F.lit("pos "), pos)), some(domain, F.concat(F.lit("domain "), domain)), some(ln, F.concat(F.lit("LN "), ln))), 1, most)


def with_text(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with text to embed, one row with the number of the others)."""
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    return rows.where(~blank), rows.where(blank).agg(F.count(F.lit(1)).alias("skipped"))


def seed(spark: SparkSession, questions: DataFrame, mapping: dict[str, str]) -> dict[str, DataFrame]:
    """Doctrine and Question dimensions and UNDER_QUESTION edges; a category without a doctrine is an error."""
    dim = spark.createDataFrame(sorted(mapping.items()), "category string, doctrine string")
    joined = questions.join(F.broadcast(dim), "category", "left")
    lost = [r[0] for r in joined.where("doctrine IS NULL").select("category").distinct().limit(10).collect()]
    if lost:
        raise ValueError(f"categories without a doctrine: {lost}")
    return {
        "Doctrine": joined.select(F.col("doctrine").alias("id")).distinct(),
        "Question": joined.select(F.col("question_id").alias("id"), "statement"),
        "UNDER_QUESTION": joined.select(F.col("question_id").alias("src_id"), F.col("doctrine").alias("dst_id"), F.lit("UNDER_QUESTION").alias("rel_type")),
    }


def wipe(spark: SparkSession, database: str) -> int:
    """Drop a database with its tables; gives how many tables are left (0)."""
    spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
    spark.sql(f"CREATE DATABASE `{database}`")
    return sum(not t.isTemporary for t in spark.catalog.listTables(database))  # views of the session are no tables of it
