"""Incremental ingest of documents as licensed chunks.

New files under ``documents`` (a folder, one file or a pattern) are taken once: a file stream with a checkpoint, run until nothing is left. Each batch packs the
documents' paragraphs to chunks, gives them their source's licence and whether it lets them be redistributed, and drops chunks whose
text an earlier batch, or an earlier document of this batch, has. Documents without an id or a word go to quarantine.

Output, all Parquet under ``out``: ``chunks`` by batch and lang, ``quarantine`` and ``manifest`` by batch. A batch writes only its own
partitions and overwrites them, and reads only those of earlier batches; so a batch that a failure repeats leaves the same files, and a
run without new files changes nothing. Of equal chunks the first by (batch, doc_id, chunk) stays.

    python -m jobs.chunk_ingest --documents PATH --out PATH --checkpoint PATH
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import licence, text
from quillgraph.operators import ordered
from quillgraph.streaming.ingest import pattern

log = logging.getLogger("chunk_ingest")

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
CHUNK = "doc_id long, chunk int, words int, text string, digest string, license string, redistribute boolean, batch long, lang string"
REFUSED = "doc_id long, source string, reason string, batch long"
MANIFEST = "name string, n long, batch long"


def packed(docs: DataFrame, target: int, least: int) -> DataFrame:
    """(doc_id, lang, source, chunk from 1, words, text): paragraphs with a word, packed greedily."""
    lines = docs.select("doc_id", "lang", "source", F.filter(F.split("text", "\n"), lambda x: text.word_count(x) > 0).alias("l"))
    chunks = lines.select("doc_id", "lang", "source", "l", F.posexplode(ordered.packed(F.transform("l", text.word_count), target, least)).alias("k", "p"))
    said = F.array_join(F.slice("l", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1), "\n")
    return chunks.select("doc_id", "lang", "source", (F.col("k") + 1).alias("chunk"), F.col("p.words").alias("words"), said.alias("text"))


def refusal() -> F.Column:
    """Why a document isn't taken; null where it is."""
    return F.when(F.col("doc_id").isNull(), "no id").when(text.word_count(F.col("text")) == 0, "no words")


def ingest_batch(docs: DataFrame, batch: int, out: str, licences: dict[str, str], target: int, least: int) -> dict[str, int]:
    """One batch of documents to its own partitions; gives its counts."""
    spark = docs.sparkSession
    rows = docs.withColumn("reason", refusal())
    bad = rows.where("reason IS NOT NULL").select("doc_id", "source", "reason", F.lit(batch).cast("long").alias("batch"))
    names = F.create_map(*[F.lit(x) for kv in licences.items() for x in kv]) if licences else F.create_map().cast("map<string,string>")
    lic = F.coalesce(F.try_element_at(names, F.col("source")), F.lit("unknown"))
    made = packed(rows.where("reason IS NULL"), target, least).withColumn("digest", F.sha2("text", 256)).withColumn("license", lic)
    made = made.withColumn("redistribute", licence.guard(F.col("license"), "bulk")["allowed"]).withColumn("lang", F.coalesce("lang", F.lit("und")))
    found = ordered.first_wins(made, ["digest"], ["doc_id", "chunk"])
    if batch:
        before = spark.read.schema(CHUNK).parquet(f"{out}/chunks").where(F.col("batch") < batch)
        found = found.join(before.select("digest"), "digest", "left_anti")
    _write(found.withColumn("batch", F.lit(batch).cast("long")).select("doc_id", "chunk", "words", "text", "digest", "license", "redistribute", "batch", "lang"), f"{out}/chunks", "batch", "lang")
    _write(bad, f"{out}/quarantine", "batch")
    n = {
        "documents": docs.count(), "made": made.count(),
        "chunks": spark.read.schema(CHUNK).parquet(f"{out}/chunks").where(F.col("batch") == batch).count(),
        "refused": spark.read.schema(REFUSED).parquet(f"{out}/quarantine").where(F.col("batch") == batch).count(),
    }
    _write(spark.createDataFrame([(k, v, batch) for k, v in n.items()], MANIFEST), f"{out}/manifest", "batch")
    return n


def _write(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, licences: dict[str, str] | None = None, target_words: int = 533, least_words: int = 106, files_per_batch: int = 1000) -> dict[str, int]:
    """Take the documents that no earlier run took, as chunks; gives the counts of this run."""
    total: dict[str, int] = {}

    def batch(docs: DataFrame, number: int) -> None:
        docs = docs.persist()  # read once for its chunks, refusals and counts
        try:
            n = ingest_batch(docs, number, out, licences or {}, target_words, least_words)
        finally:
            docs.unpersist()
        log.info("batch %d: read %d documents of %s, refused %d, wrote %d of %d chunks to %s", number, n["documents"], documents, n["refused"], n["chunks"], n["made"], out)
        for k, v in n.items():
            total[k] = total.get(k, 0) + v

    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).parquet(pattern(documents))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("run ended: %s", total or "nothing new")
    return total


def output(spark: SparkSession, out: str) -> DataFrame:
    """(kind, batch, doc_id, chunk, lang, words, redistribute, detail, n): everything under ``out``."""
    none = lambda kind: F.lit(None).cast(kind)
    c = spark.read.schema(CHUNK).parquet(f"{out}/chunks").select(F.lit("chunk").alias("kind"), "batch", "doc_id", "chunk", "lang", "words", "redistribute", F.col("digest").alias("detail"), none("long").alias("n"))
    q = spark.read.schema(REFUSED).parquet(f"{out}/quarantine").select(F.lit("refused").alias("kind"), "batch", "doc_id", none("int").alias("chunk"), none("string").alias("lang"), none("int").alias("words"), none("boolean").alias("redistribute"), F.col("reason").alias("detail"), none("long").alias("n"))
    m = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").select(F.lit("manifest").alias("kind"), "batch", none("long").alias("doc_id"), none("int").alias("chunk"), none("string").alias("lang"), none("int").alias("words"), none("boolean").alias("redistribute"), F.col("name").alias("detail"), "n")
    return c.unionByName(q).unionByName(m)


if __name__ == "__main__":
    from jobs.common import main

    main(run, "chunk_ingest", ["documents", "out", "checkpoint"])
