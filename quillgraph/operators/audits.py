"""Audits of texts: question stems that give an answer away, and lines that still use fields of an older schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of each family of a stem's faults, without regard to case.
STEM_FLAGS = {
    "NAMED_CARRIERS": [
        r"\bMormon(?:ism)?\b", r"\bLDS\b", r"\bBook of Mormon\b", r"\bJehovah's Witness(?:es)?\b", r"\bWatchtower\b", r"\bWatch Tower\b", r"\bChristian Science\b", r"\bIglesia ni Cristo\b", r"\bManalo\b",
        r"\bEllen G\.? White\b", r"\bSeventh-day Adventist\b", r"\bChildren of God\b", r"\bMo Letters\b", r"\bBranham(?:ism)?\b", r"\bWord-Faith\b", r"\bWord of Faith\b", r"\bUnification(?: Church)?\b", r"\bDivine Principle\b",
        r"\bICC\b", r"\bInternational Churches of Christ\b", r"\bBritish Israelism\b", r"\bSerpent Seed\b", r"\bRoman Catholic(?:ism)?\b", r"\bHyper-Calvinis(?:m|t)\b",
    ],
    "VERDICT_PRELOADED": [
        r"\bis (?:cult-grade|heresy|heretical|heterodox|unbiblical|false gospel)\b", r"\bare (?:cult-grade|heresy|heretical|heterodox|unbiblical|false gospel)\b", r"\bis (?:rejected|denied|refuted) by Scripture\b",
        r"\bcorrupts? the gospel\b", r"\bis a damning error\b", r"\bdenial (?:of [\w\s]+ )?(?:is|=) cult-grade\b", r"\bcult-grade error\b",
    ],
    "CONFESSIONAL_VOCAB": [
        r"\bsola fide\b", r"\bsola gratia\b", r"\bsolus christus\b", r"\bsola scriptura\b", r"\bsoli Deo gloria\b", r"\bimputed righteousness\b", r"\bimputation\b", r"\bforensic justification\b", r"\bforensic\b", r"\bperspicuity\b",
        r"\bregulative principle\b", r"\bcovenant of grace\b", r"\bcovenant of works\b", r"\bex opere operato\b", r"\bpropitiat(?:e|ing|ion)\b", r"\bex cathedra\b",
    ],
    "META_FRAMING": [
        r"\bis a legitimate (?:orthodox )?position\b", r"\bis the historic Brethren position\b", r"\bis the historic position of\b", r"\bis a defensible position\b", r"\bis tenable\b",
    ],
}

#: What a line has that an older schema left there, by category; the first of a pair keeps the second from counting.
SCORE, CONFIDENCE, VERSION_KEY = (r"\bcompute_lexical_score\b", r"\blexical_score\b"), (r'"confidence"\s*:\s*"(high|medium|low)"', r"\b(verdict|evidence\.verdict|result|raw)\.confidence\b"), r"(\$?schema_version|SCHEMA_VERSION)"
LITERAL, OLD_VERSION = r'"\$schema_version"\s*:\s*"3\.0"', r"\"3\.0\"|'3\.0'"
#: Marks of lines that may speak of it.
PRAGMA, MARKERS, HEADINGS = "v30-dead-ref-ok", ["Migration history", "v3.0 (superseded)", "v3.0 -> v3.1", "v3.0 to v3.1", "v2.0 -> v3.0", "v2.0 to v3.0"], ["historical", "archived", "migration"]
AROUND = 2
SNIPPET = 200


def stem_flags(statement: Column) -> Column:
    """array<struct<flag, matches>>: the families that a statement has matches of, with all of them by pattern, then by place."""
    text = F.coalesce(statement, F.lit(""))

    def family(name: str, patterns: list[str]) -> Column:
        found = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)) for p in patterns))
        return F.struct(F.lit(name).alias("flag"), found.alias("matches"))

    return F.filter(F.array(*(family(n, p) for n, p in STEM_FLAGS.items())), lambda f: F.size(f["matches"]) > 0)


def line_findings(texts: DataFrame, module: str = r"[\w.]*evidence_schema") -> DataFrame:
    """(id, line_no from 1, category, snippet) of texts (id, text): a row for each category that a line falls into.

    An old version's number counts where a line up to ``AROUND`` before or after speaks of a schema version. ``module``: a pattern of
    the module that an old name came from.
    """
    every = texts.select("id", F.split(F.regexp_replace("text", "\r\n?|\n\\z", "\n"), "\n").alias("__l"))
    rows = every.select("id", "__l", F.posexplode("__l").alias("__k", "line"))
    allowed = reduce(lambda a, b: a | b, (F.contains("line", F.lit(m)) for m in MARKERS))
    heading = F.ltrim("line").startswith("#") & reduce(lambda a, b: a | b, (F.contains("line", F.lit(w)) for w in HEADINGS))
    near = F.slice("__l", F.greatest(F.col("__k") - AROUND, F.lit(0)) + 1, F.least(F.col("__k"), F.lit(AROUND)) + 1 + AROUND)
    has = lambda p: F.col("line").rlike(p)
    spoken = F.exists(near, lambda x: x.rlike(VERSION_KEY))
    literal = has(LITERAL)
    categories = F.array_compact(F.array(
        F.when(has(SCORE[0]), "compute_lexical_score").when(has(SCORE[1]), "lexical_score"),
        F.when(has(CONFIDENCE[0]) | has(CONFIDENCE[1]), "verdict_confidence"),
        F.when(has(rf"from\s+{module}\s+import\s+([^\n]*\bConfidence\b[^\n]*)"), "Confidence_import"),
        F.when(literal, "schema_literal_3.0").when(has(OLD_VERSION) & spoken, "schema_version_3.0"),
    ))
    rows = rows.where(~F.contains("line", F.lit(PRAGMA)) & ~allowed & ~heading)
    return rows.select("id", (F.col("__k") + 1).alias("line_no"), F.explode(categories).alias("category"), F.substring(F.trim("line"), 1, SNIPPET).alias("snippet"))
