"""Quality rules as weak supervision, in Column expressions only.

Rules vote good (1), bad (0) or abstain (null). The votes of all documents are counted by pattern (at most
3 ** rules patterns, so the counts have a fixed size bound); expectation-maximisation over those counts estimates how
often each rule votes good for good and for bad documents; a document is kept if its posterior probability of being
good is at least ``threshold`` and it doesn't fail the base check. EM runs inside one SQL expression over the pattern
counts: ``aggregate`` over the iterations, with the model as accumulator.

Defined results: a null or empty text has no words, fails the base check and is not kept; repeated rows and ties get
equal results; null ids are kept; an empty table gives no rows; other columns are ignored; whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

#: White space between words, and symbol characters.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ITERATIONS = 20
#: Votes as good / bad limits of each measure; between them a rule abstains. (name, measure, good if, bad if)
RULES = [
    ("length", "n_words >= 80", "n_words < 50"),
    ("word_chars", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("dup_lines", "n_dup_lines = 0", "n_dup_lines > 0 AND 5 * n_dup_lines > n_lines"),
    ("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
]
#: Start of EM: P(vote good | good), P(vote good | bad), P(good). Rules are taken to be better than chance.
START = (0.8, 0.3, 0.7)
#: Votes are smoothed by so many imagined ones of the start's rates.
PRIOR_VOTES = 20.0


def measures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word)."""
    text = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    blank = F.translate("__t", SPACE, "")
    parts = text.select(
        *keep,
        F.length(blank).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.array_remove(F.split("__t", "[ \\t\\n\\x0B\\f\\r]+"), "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("__l"),
    )
    # a window's hash; equal windows have equal hashes, and documents whose windows all differ stop here
    windows = parts.select(
        *keep, "word_chars", "n_symbols",
        F.size("__w").cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(__w) > 3 THEN transform(slice(__w, 1, size(__w) - 2), (x, i) -> xxhash64(x, __w[i + 1], __w[i + 2])) ELSE cast(array() AS array<bigint>) END").alias("__h"),
    )
    # positions of windows found twice or more, in order; each adds the words that the one before it did not cover
    spots = windows.withColumn("__s", F.expr(
        "CASE WHEN size(array_distinct(__h)) = size(__h) THEN cast(array() AS array<struct<h: bigint, i: int>>) "
        "ELSE sort_array(transform(__h, (h, i) -> named_struct('h', h, 'i', i))) END"
    ))
    repeated = spots.withColumn("__r", F.expr(
        "sort_array(transform(filter(__s, (s, k) -> (k > 0 AND __s[k - 1].h = s.h) OR (k + 1 < size(__s) AND __s[k + 1].h = s.h)), s -> s.i))"
    ))
    covered = F.expr("cast(aggregate(transform(__r, (p, k) -> CASE WHEN k = 0 THEN 3 ELSE least(3, p - __r[k - 1]) END), 0, (a, x) -> a + x) AS bigint)")
    return repeated.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines")


def votes(rules=RULES) -> list[Column]:
    return [F.expr(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN 0 END") for _, good, bad in rules]


def _odds(n: int) -> str:
    """SQL: P(votes | good) and P(votes | bad) of pattern ``p`` under model ``m``."""
    def side(k: str) -> str:
        return " * ".join(f"(CASE p.v[{j}] WHEN 1 THEN m.{k}[{j}] WHEN 0 THEN 1 - m.{k}[{j}] ELSE 1D END)" for j in range(n))

    return f"m.q * {side('a')} / (m.q * {side('a')} + (1 - m.q) * {side('b')})"


def em_sql(n: int, iterations: int = ITERATIONS) -> str:
    """SQL over an array ``patterns`` of struct(v array<int>, c double): the model struct(q, a, b) after EM."""
    a0, b0, q0 = START
    first = f"named_struct('q', {q0}D, 'a', array_repeat({a0}D, {n}), 'b', array_repeat({b0}D, {n}))"

    def rate(weight: str, start: float) -> str:
        voted = f"aggregate(e, 0D, (s, p) -> s + CASE WHEN p.v[j] IS NOT NULL THEN {weight} ELSE 0D END)"
        good = f"aggregate(e, 0D, (s, p) -> s + CASE WHEN p.v[j] = 1 THEN {weight} ELSE 0D END)"
        return f"transform(sequence(0, {n - 1}), j -> ({good} + {PRIOR_VOTES * start}D) / ({voted} + {PRIOR_VOTES}D))"

    # the posterior of each pattern, bound by a one-element transform so that it is worked out once a step
    e_step = f"transform(patterns, p -> named_struct('v', p.v, 'c', p.c, 'g', {_odds(n)}))"
    m_step = (
        "named_struct('q', (aggregate(e, 0D, (s, p) -> s + p.c * p.g) + 1D) / (aggregate(e, 0D, (s, p) -> s + p.c) + 2D), "
        f"'a', {rate('p.c * p.g', a0)}, 'b', {rate('p.c * (1 - p.g)', b0)})"
    )
    return f"aggregate(sequence(1, {iterations}), {first}, (m, step) -> transform(array({e_step}), e -> {m_step})[0])"


def weak_quality(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep`` columns (doc_id), the measures, base_failed, the posterior ``quality`` and ``kept``."""
    keep = keep or ["doc_id"]
    n = len(RULES)
    # the narrow measures are written once, as both the counts and the verdicts read them
    measured = common.stored(measures(docs, keep, text_col), common.run_dir(docs.sparkSession, "quality"))
    voted = measured.withColumn("__v", F.array(*votes()))
    counts = voted.groupBy("__v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    # at most 3 ** n rows: one row with all pattern counts, and each pattern's posterior
    model = counts.agg(F.sort_array(F.collect_list(F.struct(F.col("__v").alias("v"), "c"))).alias("patterns")).select("patterns", F.expr(em_sql(n)).alias("m"))
    posterior = model.select(F.explode(F.expr(f"transform(patterns, p -> named_struct('v', p.v, 'g', {_odds(n)}))")).alias("p"))
    key = lambda c: F.array_join(c, ",", "-")
    posterior = posterior.select(key(F.col("p.v")).alias("__k"), F.col("p.g").alias("quality"))
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    rows = voted.withColumn("__k", key(F.col("__v"))).join(F.broadcast(posterior), "__k", "left")
    return rows.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (F.col("quality") >= threshold)).alias("kept"), F.round("quality", 6).alias("quality"),
    )
