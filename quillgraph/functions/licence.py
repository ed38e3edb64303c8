"""Redistribution rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Licence slugs by what they allow, in lower case.
ALWAYS = ["public_domain", "pd", "cc0", "cc-by", "cc-by-4.0", "cc-by-sa-4.0"]
CAPPED = ["cc-by-nc-4.0", "parsed-sanitized"]
PROPRIETARY = ["©", "(c)", "copyright", "proprietary", "fair-use"]
COMPOSITE = {"macula-hebrew": "CC-BY-NC-4.0", "macula-greek": "CC-BY-NC-4.0"}
SNIPPET_WORDS = 100
SNIPPET_SHARE = 0.01


def effective(licence: Column) -> Column:
    """The licence that a slug for a composite source stands for."""
    out = licence
    for slug, means in COMPOSITE.items():
        out = F.when(F.lower(licence) == slug, F.lit(means)).otherwise(out)
    return out


def guard(licence: Column, mode: Column | str, n_words: Column | int = 0, source_words: Column | int = 0) -> Column:
    """struct(allowed, reason) of using text under ``licence`` in ``mode`` (bulk or snippet)."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    n, of = (F.lit(x) if isinstance(x, int) else x for x in (n_words, source_words))
    eff = effective(licence)
    key = F.lower(eff)
    note = F.when(key != F.lower(licence), F.concat(F.lit(" (composite '"), licence, F.lit("' resolved to "), eff, F.lit(")"))).otherwise("")
    capped = key.isin(*CAPPED)
    for p in PROPRIETARY:
        capped = capped | key.startswith(p)
    name = F.when(key == "cc-by-nc-4.0", F.lit("CC-BY-NC-4.0")).otherwise(eff)

    def verdict(ok: bool, *parts) -> Column:
        return F.struct(F.lit(ok).alias("allowed"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("reason"))

    return (
        F.when(mode.isNull() | ~mode.isin("bulk", "snippet"), verdict(False, "invalid mode: '", F.coalesce(mode, F.lit("None")), "'"))
        .when(licence.isNull() | (F.trim(licence) == ""), verdict(False, "empty license"))
        .when(key.isin(*ALWAYS), verdict(True, eff, " always allowed", note))
        .when((key == "sblgnt-eula") & (mode == "bulk"), verdict(False, "SBLGNT-EULA denies bulk", note))
        .when(key == "sblgnt-eula", verdict(True, "SBLGNT-EULA allows snippet (caller tracks 500-verses cap)", note))
        .when(capped & (mode == "bulk"), verdict(False, name, " denies bulk", note))
        .when(capped & (n <= 0), verdict(False, eff, " snippet requires positive word count", note))
        .when(capped & (n > SNIPPET_WORDS), verdict(False, eff, f" snippet exceeds {SNIPPET_WORDS} word cap", note))
        .when(capped & (of <= 0), verdict(False, eff, " snippet requires positive source word count", note))
        .when(capped & (n > SNIPPET_SHARE * of), verdict(False, eff, " snippet exceeds 1% of source", note))
        .when(capped, verdict(True, eff, " snippet within caps", note))
        .otherwise(verdict(False, "unrecognized license: '", licence, "'"))
    )


def mode_of(context: Column) -> Column:
    """Sharing in public and exporting are bulk uses."""
    return F.when(context.isin("public-share", "export"), "bulk").otherwise("snippet")


def envelope(sources: Column, context: Column, n_words: Column | int = 0, source_words: Column | int = 0) -> Column:
    """Audit of ``sources`` (array of struct(source, license)): checked sources, safe, and why not.

    No sources means not safe: nothing shows that sharing is allowed.
    """
    checked = F.transform(sources, lambda s: F.struct(s["source"].alias("source"), s["license"].alias("license"), guard(s["license"], mode_of(context), n_words, source_words).alias("g")))
    reasons = F.transform(F.filter(checked, lambda s: ~s["g"]["allowed"]), lambda s: F.concat(s["source"], F.lit(": "), s["g"]["reason"]))
    none = F.size(sources) == 0
    return F.struct(
        F.transform(checked, lambda s: F.struct(s["source"].alias("source"), s["license"].alias("license"), s["g"]["allowed"].alias("redistribute"))).alias("sources_used"),
        F.when(none, False).otherwise(F.forall(checked, lambda s: s["g"]["allowed"])).alias("response_safe_to_share"),
        F.when(none, "no sources declared").when(F.size(reasons) > 0, F.array_join(reasons, "; ")).alias("non_redistributable_reason"),
    )


def rollup(sources: Column, empty: bool) -> Column:
    """Are all sources free for bulk use? ``empty`` is the answer for no sources, which differs by caller."""
    return F.when(F.size(sources) == 0, empty).otherwise(F.forall(sources, lambda s: guard(s["license"], "bulk")["allowed"]))
