"""Invariants over whole stores: graph, bundles of anchors, and historical outputs. All give (name, ok, observed, expected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import checks, documents, graph

#: Cross references of one anchor that a bundle may hold.
XREF_LIMIT = 60
NO_ROWS = "verse_id string, id string"


def _zero(name: str, rows: DataFrame) -> DataFrame:
    return checks.check(name, rows.agg(F.count(F.lit(1))), F.col("observed") == 0, "0")


def graph_checks(nodes: dict[str, DataFrame], edges: DataFrame, lemmas: DataFrame, nullable: list[str], placeholders: list[str], floors: dict[str, int]) -> DataFrame:
    """Orphans by label (nodes: id), lemmas without repeats, self loops, glosses and placeholders (lemmas: id, strong, gloss,
    source), and the least number of edges of each kind (edges: src_id, dst_id, rel_type)."""
    rows = [_zero(f"orphan_free[{label}]", graph.orphans(n.select("id"), edges)) for label, n in sorted(nodes.items())]
    rows.append(_zero("lemma_distinct_per_strong", graph.duplicates(lemmas.where("strong IS NOT NULL"), ["strong"])))
    rows.append(_zero("instance_of_no_self_loops", edges.where("rel_type = 'INSTANCE_OF' AND src_id = dst_id")))
    named = ~F.coalesce("source", F.lit("")).isin(*nullable) if nullable else F.lit(True)
    rows.append(_zero("gloss_coverage", lemmas.where((F.coalesce("gloss", F.lit("")) == "") & named)))
    counts = edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    for rel, low in sorted(floors.items()):
        rows.append(checks.check(f"edge_floor[{rel}]", counts.where(F.col("rel_type") == rel).agg(F.coalesce(F.sum("n"), F.lit(0))), F.col("observed") >= low, f">= {low}"))
    for p in placeholders:
        rows.append(_zero(f"no_placeholder[{p}]", lemmas.where((F.col("id") == p) | (F.col("strong") == p))))
    return reduce(DataFrame.unionByName, rows)


def subset(a: Column, b: Column) -> Column:
    """Whether all elements of ``a`` are in ``b``; missing arrays are empty."""
    empty = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(a, empty), F.coalesce(b, empty))) == 0


def same_rows(name: str, source: DataFrame, projected: DataFrame, key: str) -> DataFrame:
    """(key, name, missing, extra) of the keys whose rows differ between a source and a bundle; both sides by hashed rows,
    so no list of a key's rows is gathered."""
    cols = [c for c in source.columns]
    s, p = source.distinct().withColumn("__s", F.lit(1)), projected.select(*cols).distinct().withColumn("__p", F.lit(1))
    on = reduce(lambda x, y: x & y, (F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in cols))
    both = s.alias("s").join(p.alias("p"), on, "full_outer").where("__s IS NULL OR __p IS NULL")
    return both.groupBy(F.coalesce(f"s.{key}", f"p.{key}").alias(key)).agg(F.lit(name).alias("name"), F.count_if(F.col("__p").isNull()).alias("missing"), F.count_if(F.col("__s").isNull()).alias("extra"))


def bundle_checks(anchors: DataFrame, source: dict[str, DataFrame], bundle: dict[str, DataFrame], in_scope: Column, flag: bool) -> DataFrame:
    """Failures (ref, name, missing, extra) of a bundle of ``anchors`` (ref) against its sources.

    Both dicts: words and syntax (ref, ...), xrefs (ref, n), variants (ref, variant); source has lemmas (strong, lemma) and
    strongs (ref, strong). ``in_scope``: which refs may have variants; ``flag``: the bundle says that none of its is.
    """
    here = lambda df: df.join(anchors.select("ref").distinct(), "ref", "left_semi")
    words = same_rows("word-completeness", here(source["words"]), bundle["words"], "ref")
    syntax = same_rows("syntactic-completeness", here(source["syntax"]), bundle["syntax"], "ref")
    lemmas = bundle["lemmas"].where(F.trim(F.coalesce("lemma", "strong")) != "").select("strong").distinct()
    lost = here(source["strongs"]).join(lemmas, "strong", "left_anti").groupBy("ref").agg(F.lit("lemma-completeness").alias("name"), F.count(F.lit(1)).alias("missing"), F.lit(0).cast("long").alias("extra"))
    x = here(source["xrefs"]).select("ref", F.col("n").alias("a")).join(bundle["xrefs"].select("ref", F.col("n").alias("b")), "ref", "full_outer")
    least = lambda c: F.least(F.lit(XREF_LIMIT), F.coalesce(c, F.lit(0)))
    x = x.select("ref", F.lit("crossref-completeness").alias("name"), (least("a") - least("b")).alias("gap")).where("gap <> 0").select("ref", "name", F.greatest("gap", F.lit(0)).cast("long").alias("missing"), F.greatest(-F.col("gap"), F.lit(0)).cast("long").alias("extra"))
    v = same_rows("variant-completeness", here(source["variants"]).where(in_scope), bundle["variants"], "ref")
    v = v.where(F.when(in_scope, F.col("missing") > 0).otherwise(F.col("extra") > 0))
    any_ = anchors.agg(F.coalesce(F.bool_or(in_scope), F.lit(False)).alias("any"))
    f = any_.where(F.col("any") == F.lit(flag)).select(F.lit("<bundle>").alias("ref"), F.lit("scope-flag").alias("name"), F.lit(1).cast("long").alias("missing"), F.lit(0).cast("long").alias("extra"))
    return reduce(DataFrame.unionByName, [words, lost, x, v, syntax, f])


def digest(bundle: dict[str, DataFrame]) -> DataFrame:
    """(section, n, digest) of a bundle, whatever the order of its rows."""
    return reduce(DataFrame.unionByName, [checks.snapshot(df).select(F.lit(k).alias("section"), "n", "digest") for k, df in sorted(bundle.items())])


def historical_gate(questions: DataFrame, files: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """Checks of the historical outputs: coverage of questions (question_id), schema, ids, safe flags and dashes of files
    (question_id, json), chunks (chunk_id, source_type), and as many points as chunks."""
    q, f = questions.select("question_id").distinct(), files.select("question_id").distinct()
    odd = q.join(f, "question_id", "left_anti").unionByName(f.join(q, "question_id", "left_anti"))
    d = documents.checked(files, "question_id", "json", "attestation")
    bad = d.where(F.size("_violations") > 0)
    a = F.col("doc.license_audit")
    parity = chunks.agg(F.count(F.lit(1)).alias("c")).crossJoin(points.agg(F.count(F.lit(1)).alias("p"))).select(F.col("c") - F.col("p"))
    return reduce(DataFrame.unionByName, [
        _zero("coverage", odd), _zero("schema_valid", bad), _zero("id_equals_question_id", d.where(F.col("doc.id") != F.col("doc.question_id"))),
        _zero("safe_flag_derivation", d.where(a["evidence_safe_to_publish"] != documents.safe(a))), _zero("dash_discipline", files.where(F.col("json").rlike(documents.DASHES))),
        checks.check("chunks", chunks.agg(F.count(F.lit(1))), F.col("observed") > 0, "> 0"), checks.check("parity", parity, F.col("observed") == 0, "0"),
    ])


def profile(chunks: DataFrame) -> DataFrame:
    """(source_type, n, works): chunks and distinct works of each type; no type is the empty one."""
    return chunks.groupBy(F.coalesce("source_type", F.lit("")).alias("source_type")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("work_id").alias("works"))


def in_bounds(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``rows`` (book, chapter, verse) with ``ok``: the verse is in its chapter, by ``lengths`` (book, chapter, verses); in a
    book that has no lengths, chapter and verse are 1 at least."""
    known = lengths.select("book").distinct().withColumn("__known", F.lit(True))
    j = rows.join(F.broadcast(known), "book", "left").join(lengths.select("book", "chapter", F.col("verses").alias("__verses")), ["book", "chapter"], "left")
    ok = F.when(F.col("__known"), F.coalesce(F.col("verse").between(F.lit(1), F.col("__verses")), F.lit(False))).otherwise((F.col("chapter") >= 1) & (F.col("verse") >= 1))
    return j.select(*rows.columns, ok.alias("ok"))


def digits(c: Column) -> Column:
    """The number that a text's digits make; null without any."""
    return F.regexp_replace(c, "\\D", "").try_cast("long")


def aligned(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows with their vectors, joined on the key and never by place; a different number of them is an error."""
    n, m = rows.select(key).distinct().count(), vectors.select(key).distinct().count()
    if n != m:
        raise ValueError(f"{n} rows, {m} vectors")
    return rows.join(vectors, key)


def question_index(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """(question_id, statement, vector as array<float>, dimension): the index that questions are matched with."""
    q = questions.select("question_id", F.coalesce("statement", F.lit("")).alias("statement"))
    return aligned(q, vectors.select("question_id", F.col("vector").cast("array<float>").alias("vector")), "question_id").withColumn("dimension", F.size("vector"))
