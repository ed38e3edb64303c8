"""A keyword index of documents, and the answers to a list of questions from it.

Builds the stored index (postings in blocks by impact, see ``quillgraph.operators.postings``) from the documents' keywords, then
searches it for every question, without a limit on their number, and writes for each its first documents by BM25.

Output, all Parquet but one line about the index, under ``out``: ``index/docs``, ``index/blocks``, ``index/terms``; ``answers`` by
lang of the document that answers; ``languages`` with counts. Everything is written in place of what is there, from the inputs
alone, so a rerun, also after a failure, leaves the same rows.

    python -m jobs.keyword_index --documents PATH --questions PATH --out PATH
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import postings

log = logging.getLogger("keyword_index")


def run(spark: SparkSession, documents: str, questions: str, out: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> dict[str, int]:
    """Index the documents and answer the questions; gives counts of what was read and written."""
    docs, asked = spark.read.parquet(documents), spark.read.parquet(questions)
    tokens = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), text.keywords(F.col("text")).alias("tokens"))
    index = postings.build(tokens, f"{out}/index", k1, b)
    log.info("read %d documents of %s, wrote %d blocks of %d terms to %s/index", index.n, documents, index.blocks.count(), index.terms.count(), out)
    q = asked.where("item_id IS NOT NULL").select(F.col("item_id").alias("query_id"), text.keywords(F.col("text")).alias("tokens"))
    hits = postings.search(index, q, k)
    of = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("und")).alias("lang")).dropDuplicates(["id"])
    hits.join(of, "id").select("query_id", "id", "score", "rank", "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/answers")
    answers = spark.read.schema("query_id long, id long, score double, rank int, lang string").parquet(f"{out}/answers")
    by = of.groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).join(answers.groupBy("lang").agg(F.count(F.lit(1)).alias("answers")), "lang", "left")
    by.select("lang", "documents", F.coalesce("answers", F.lit(0)).alias("answers")).write.mode("overwrite").parquet(f"{out}/languages")
    n = {"documents": index.n, "questions": q.count(), "answers": answers.count()}
    log.info("read %d questions of %s, wrote %d answers to %s/answers", n["questions"], questions, n["answers"], out)
    return n


def output(spark: SparkSession, out: str) -> DataFrame:
    """(part, query_id, id, token, lang, n, score, rank): answers, terms with their document counts, and languages."""
    none = lambda kind: F.lit(None).cast(kind)
    a = spark.read.schema("query_id long, id long, score double, rank int, lang string").parquet(f"{out}/answers").select(F.lit("answer").alias("part"), "query_id", "id", none("string").alias("token"), "lang", none("long").alias("n"), F.round("score", 3).alias("score"), "rank")
    t = spark.read.parquet(f"{out}/index/terms").select(F.lit("term").alias("part"), none("long").alias("query_id"), none("long").alias("id"), "token", none("string").alias("lang"), F.col("df").alias("n"), none("double").alias("score"), none("int").alias("rank"))
    g = spark.read.parquet(f"{out}/languages")
    each = lambda c: g.select(F.lit(c).alias("part"), none("long").alias("query_id"), none("long").alias("id"), none("string").alias("token"), "lang", F.col(c).alias("n"), none("double").alias("score"), none("int").alias("rank"))
    return a.unionByName(t).unionByName(each("documents")).unionByName(each("answers"))


if __name__ == "__main__":
    from jobs.common import main

    main(run, "keyword_index", ["documents", "questions", "out"])
