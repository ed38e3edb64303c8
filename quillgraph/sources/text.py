"""Line-based sources. Every row carries its file and line, so that orders and first-wins rules are well defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.operators import ordered


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8", glob: str | None = None) -> DataFrame:
    """(file, line_no from 1, line); a byte-order mark is dropped. ``glob``: names of the files that count, at any depth.

    The part files of a folder that Spark wrote are one source in the order of their names; its ``file`` is the folder.

    UTF-8 and Latin-1 files are read in splits, whatever their size: a line's number is that of the lines in the file's splits before
    (one small row a split) and its place in its own. Other encodings are read whole, a row each, then split.
    """
    latin = encoding.upper() == "ISO-8859-1"
    if not latin and encoding.upper() not in ("UTF-8", "US-ASCII"):
        raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("t"))
        out = raw.select("file", F.posexplode(F.split(F.regexp_replace("t", "(\r\n|\n|\r)\\z", ""), "\r\n|\n|\r")).alias("at", "line"))
        return out.select("file", (F.col("at") + 1).alias("line_no"), "line")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob) if glob else spark.read
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line") if latin else F.col("value").alias("line"))
    split = raw.groupBy("__path", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    split = split.withColumn("file", F.regexp_replace("__path", "/part-[0-9]{5}[^/]*$", ""))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("file").orderBy("__path", "__start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    split = split.select("__path", "__start", "file", "__first", before.alias("__before"))
    n = (F.col("__before") + F.col("__id") - F.col("__first") + 1).cast("int")
    # a row for each split of some megabytes: a millionth of the text
    numbered = raw.join(F.broadcast(split), ["__path", "__start"]).select("file", n.alias("line_no"), "line")
    return numbered.withColumn("line", F.when(F.col("line_no") == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))


def fields(rows: DataFrame, names: list[str], sep: str = "\t") -> DataFrame:
    """Split ``line`` into named columns; missing ones at the end are empty."""
    part = F.split("line", sep)
    return rows.select("file", "line_no", *(F.coalesce(F.get(part, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)))


def tsv(spark: SparkSession, path: str, names: list[str], header: bool = True) -> DataFrame:
    """Tab-separated text without quoting; blank lines are skipped and short rows filled with empty strings."""
    rows = lines(spark, path).where(F.trim("line") != "")
    return fields(rows.where("line_no > 1") if header else rows, names)


def after_header(rows: DataFrame, header: Column) -> DataFrame:
    """Rows of each file below its first row for which ``header`` holds."""
    seen = ordered.scan(rows.withColumn("__h", F.coalesce(header, F.lit(False))), ["file"], "line_no", counts={"__n": F.col("__h")})
    return seen.where(F.col("__n") > F.col("__h").cast("int")).select(*rows.columns)


def matching(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.where(F.col("line").rlike(pattern))


def positional(rows: DataFrame, names: list[str]) -> DataFrame:
    """White-space fields; rows with fewer than ``names`` are dropped."""
    part = F.split(F.trim("line"), "\\s+")
    return rows.where(F.size(part) >= len(names)).select("file", "line_no", *(part[k].alias(n) for k, n in enumerate(names)))


def typed(rows: DataFrame, ints: list[str]) -> DataFrame:
    """Cast columns to int and drop rows where one can't be."""
    out = rows.withColumns({c: F.col(c).try_cast("int") for c in ints})
    return out.dropna(subset=ints)


def blocks(rows: DataFrame, opens: Column) -> DataFrame:
    """Group lines into blocks that start at a line for which ``opens`` holds: (file, block, line_no, head, details)."""
    groups = ordered.scan(rows, ["file"], "line_no", counts={"block": opens}).where("block > 0").groupBy("file", "block")
    out = groups.agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return out.select("file", "block", F.col("l")[0]["line_no"].alias("line_no"), F.col("l")[0]["line"].alias("head"), F.expr("transform(slice(l, 2, size(l)), x -> x.line)").alias("details"))


def rule_rows(rows: DataFrame) -> DataFrame:
    """Versification rules: five or six tab-separated columns, # comments; (file, line_no, from_scheme, ...)."""
    kept = rows.where(~F.col("line").rlike("^\\s*(#|$)"))
    return fields(kept, ["from_scheme", "from_ref", "to_scheme", "to_ref", "rule_type", "block_scope"])
