"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe_tree, langid, line_dedup, lsi_decontam, phrases, repair, simhash_trie, suffix_dedup, token_count, toxicity_mil, warc, weak_quality
from quillgraph.llm.common import prepare, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages as single gzip streams, normalised to a member for each record, and read back."""
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents through a digest cache."""
    prepare(spark)
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents with a grammar for each shard, read back."""
    return repair.id_files(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_lsi_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return lsi_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents, by leaves and joins."""
    prepare(spark)
    return bpe_tree.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from document labels."""
    return toxicity_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents, and the earlier line that it repeats but for a word."""
    return line_dedup.line_duplicates(table(spark, sf_dir, "documents")).drop("__row", "__x", "__y")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by cross-parsing."""
    return langid.predict(table(spark, sf_dir, "documents"))


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents from rules that vote or abstain."""
    return weak_quality.weak_quality(table(spark, sf_dir, "documents"))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components that they link into."""
    prepare(spark)
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first collocations in all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without passages that an earlier one has."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_repair": op3_repair,
    "op4_lsi_decontam": op4_lsi_decontam,
    "op5_bpe_tree": op5_bpe_tree,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_langid": op8_langid,
    "op9_weak_quality": op9_weak_quality,
    "op10_simhash_trie": op10_simhash_trie,
    "op11_phrases": op11_phrases,
    "op12_suffix_dedup": op12_suffix_dedup,
}

#: Payload digests in DuckDB: SHA-1 in hex, read as bits, five at a time in the base32 alphabet.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS s FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(s, i + 1, 1))]), '') AS bits FROM h),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest FROM b),
t AS (SELECT s, max(page_id) AS top FROM h GROUP BY s)
SELECT d.page_id, payload_bytes, payload_digest, CASE WHEN d.page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id < top THEN top END AS refers_to
FROM d JOIN t USING (s)
"""

#: Word edit distance one, as: equal after deleting the word at the same place, or one is the other with a word deleted.
OP7_SQL = """
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM raw WHERE regexp_matches(raw, '\\S')),
f AS (SELECT line, min({'d': doc_id, 'l': line_no}) AS f FROM l GROUP BY line),
w AS (SELECT line, f, regexp_split_to_array(line, '\\s+') AS w FROM f),
n AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS plain FROM w WHERE len(w) >= 5),
g AS (SELECT *, unnest(range(1, n + 1)) AS i FROM n),
v AS (SELECT line, f, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM g),
t AS (SELECT a.line, b.f FROM v a JOIN v b ON a.v = b.v AND a.i = b.i WHERE b.f < a.f
  UNION ALL SELECT a.line, b.f FROM v a JOIN n b ON a.v = b.plain WHERE b.f < a.f
  UNION ALL SELECT b.line, a.f FROM v a JOIN n b ON a.v = b.plain WHERE a.f < b.f),
near AS (SELECT line, min(f) AS near FROM t GROUP BY line)
SELECT doc_id, line_no, CASE WHEN {'d': doc_id, 'l': line_no} <> f.f THEN 'exact' WHEN near IS NOT NULL THEN 'near' ELSE 'kept' END AS kind,
  CASE WHEN {'d': doc_id, 'l': line_no} <> f.f THEN f.f.d ELSE near.d END AS of_doc_id,
  CASE WHEN {'d': doc_id, 'l': line_no} <> f.f THEN f.f.l ELSE near.l END AS of_line_no
FROM l JOIN f USING (line) LEFT JOIN near USING (line)
"""



def quality_sql() -> str:
    """Measures, votes, EM (a recursion over the pattern counts as one list) and verdicts."""
    n, (a0, b0, q0), k = len(weak_quality.RULES), weak_quality.START, weak_quality.PRIOR_VOTES
    votes = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN 0 END" for _, good, bad in weak_quality.RULES)

    def odds(model: str) -> str:
        side = lambda c: " * ".join(f"(CASE p.v[{j}] WHEN 1 THEN {model}.{c}[{j}] WHEN 0 THEN 1 - {model}.{c}[{j}] ELSE 1::DOUBLE END)" for j in range(1, n + 1))
        return f"{model}.q * {side('a')} / ({model}.q * {side('a')} + (1 - {model}.q) * {side('b')})"

    total = lambda x: f"list_sum(list_transform(e, lambda p: {x}))"

    def rates(weight: str, start: float) -> str:
        one = lambda j: f"({total(f'CASE WHEN p.v[{j}] = 1 THEN {weight} ELSE 0 END')} + {k * start}::DOUBLE) / ({total(f'CASE WHEN p.v[{j}] IS NOT NULL THEN {weight} ELSE 0 END')} + {k}::DOUBLE)"
        return f"[{', '.join(map(one, range(1, n + 1)))}]"

    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT spot) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, [{votes}] AS v FROM m),
pats AS (SELECT list({{'v': v, 'c': c}}) AS ps FROM (SELECT v, count(*)::DOUBLE AS c FROM v GROUP BY v)),
em AS (SELECT 0 AS step, {q0}::DOUBLE AS q, {[a0] * n}::DOUBLE[] AS a, {[b0] * n}::DOUBLE[] AS b UNION ALL
  SELECT step + 1, ({total('p.c * p.g')} + 1) / ({total('p.c')} + 2), {rates('p.c * p.g', a0)}, {rates('p.c * (1 - p.g)', b0)}
  FROM (SELECT em.step, list_transform(ps, lambda p: {{'v': p.v, 'c': p.c, 'g': {odds('em')}}}) AS e FROM em, pats WHERE em.step < {weak_quality.ITERATIONS})),
g AS (SELECT p.v, {odds('em')} AS quality FROM em, (SELECT unnest(ps) AS p FROM pats) WHERE step = {weak_quality.ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND quality >= 0.5 AS kept, round(quality, 6) AS quality
FROM v JOIN g ON v.v IS NOT DISTINCT FROM g.v
"""


#: Words of pieces by place; counts by self-offsets; products as 128-bit integers.
OP11_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.m, k.phrase, k.a, arg_min({'l': x.f, 'r': y.f, 's': 1000000 * k.a * k.a // (x.f * y.f)}, {'s': 1000000 * k.a * k.a // (x.f * y.f), 'k': k}) AS b
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ') GROUP BY ALL),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.s DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, b.l::BIGINT AS l, b.r::BIGINT AS r, n, b.s::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op11_phrases": OP11_SQL, "op9_weak_quality": quality_sql(), "op1_warc": OP1_SQL, "op7_line_dedup": OP7_SQL}
