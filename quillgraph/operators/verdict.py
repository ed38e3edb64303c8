"""Verdict scoring, comparison of runs, and document rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights, caps, floors and bands of the breadth score.
WEIGHTS = {"pan": 0.25, "anchors": 0.20, "complicating": 0.15, "xrefs": 0.15, "robust": 0.15, "concordance": 0.10}
CAPS = {"anchors": 8, "xrefs": 12, "concordance": 10}
FLOORS = {"pan": 0.3, "robust": 0.5}
BANDS = [("canon_wide", 0.85), ("broad", 0.70), ("partial", 0.50)]


def breadth(pan: Column, robust: Column, anchors: Column, xrefs: Column, concordance: Column, complicating: Column, addressed: Column) -> Column:
    """Score from 0 to 1 of counts and flags, rounded to six places."""
    share = lambda c, k: F.least(c, F.lit(CAPS[k])) / CAPS[k]
    parts = {
        "pan": F.when(pan, 1.0).otherwise(FLOORS["pan"]), "anchors": share(anchors, "anchors"),
        "complicating": F.when(complicating > 0, addressed / complicating).otherwise(1.0), "xrefs": share(xrefs, "xrefs"),
        "robust": F.when(robust, 1.0).otherwise(FLOORS["robust"]), "concordance": share(concordance, "concordance"),
    }
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + w * parts[k]
    return F.round(total, 6)


def band(score: Column, pan: Column) -> Column:
    return F.when((score >= BANDS[0][1]) & pan, BANDS[0][0]).when(score >= BANDS[1][1], BANDS[1][0]).when(score >= BANDS[2][1], BANDS[2][0]).otherwise("thin")


def stability(ecm_status: Column, robust: Column) -> Column:
    return F.when(ecm_status == "n/a", "not_in_scope").when(robust, "stable").otherwise("sensitive")


def compare(a: DataFrame, b: DataFrame, key: str, equal: list[str], sets: list[str], close: dict[str, float]) -> DataFrame:
    """(key, passed, reasons): two runs row by row. ``equal`` columns must match (nulls equal), ``sets`` have the same
    elements, ``close`` differ by the given amount at most; rows that one run lacks fail."""
    x, y = a.alias("a"), b.alias("b")
    both = x.join(y, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    one_side = F.when(F.col(f"a.{key}").isNull(), F.lit("missing in a")).when(F.col(f"b.{key}").isNull(), F.lit("missing in b"))
    why = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(f"{c} mismatch")) for c in equal]
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    why += [F.when((F.size(F.array_except(empty(F.col(f"a.{c}")), empty(F.col(f"b.{c}")))) > 0) | (F.size(F.array_except(empty(F.col(f"b.{c}")), empty(F.col(f"a.{c}")))) > 0), F.lit(f"{c} set mismatch")) for c in sets]
    why += [F.when(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > tol, F.lit(f"{c} drift")) for c, tol in close.items()]
    reasons = F.when(one_side.isNotNull(), F.array(one_side)).otherwise(F.filter(F.array(*why), lambda r: r.isNotNull()))
    return both.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, "; ").alias("reasons"))


#: Verdicts at rest, and the evidence documents' word limits.
AFFIRMS = ["true", "false", "null", "disputed"]
EVIDENCE_WORDS = (100, 500)


def tag_rules() -> list[tuple[str, Column]]:
    """Rules of a doctrine tag with columns stance, confidence, evidence_phrase."""
    return [
        ("stance", F.col("stance").isin("affirms", "denies", "qualifies", "describes")),
        ("confidence", F.col("confidence").between(0, 1)),
        ("phrase", F.size(F.split(F.trim("evidence_phrase"), "\\s+")) <= 30),
    ]


def top_tags(tags: Column, least: float = 0.6, most: int = 5) -> Column:
    """Tags of at least ``least`` confidence, the surest first (input order among equals), ``most`` of them."""
    marked = F.transform(F.filter(tags, lambda t: t["confidence"] >= least), lambda t, i: F.struct((-t["confidence"]).alias("o"), i.alias("i"), t.alias("t")))
    return F.transform(F.slice(F.sort_array(marked), 1, most), lambda x: x["t"])


def best_tag(tags: Column, prefer: Column) -> Column:
    """The surest tag; those whose doctrine is ``prefer`` come before all others; bad confidence counts as 0."""
    own = F.filter(tags, lambda t: t["doctrine"] == prefer)
    pool = F.when(F.size(own) > 0, own).otherwise(tags)
    marked = F.transform(pool, lambda t, i: F.struct((-F.coalesce(t["confidence"], F.lit(0.0))).alias("o"), i.alias("i"), t.alias("t")))
    return F.get(F.sort_array(marked), F.lit(0))["t"]


def stance_counts(tags: DataFrame, by: list[str], example: str, order: list[str]) -> DataFrame:
    """(by, stance, n, examples): counts by stance, null as unstated, and the first two examples; only those two of each
    stance are gathered."""
    rows = tags.withColumn("stance", F.coalesce("stance", F.lit("unstated")))
    n = rows.groupBy(*by, "stance").agg(F.count(F.lit(1)).alias("n"))
    two = rows.withColumn("__k", F.row_number().over(W.partitionBy(*by, "stance").orderBy(*order, example))).where("__k <= 2")
    shown = two.groupBy(*by, "stance").agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", example))), lambda x: x[example]).alias("examples"))
    return n.join(shown, [*by, "stance"])
