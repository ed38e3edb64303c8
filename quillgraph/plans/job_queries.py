"""The runnable jobs as queries: each runs twice into one new folder, and gives the whole output after the second run."""

from __future__ import annotations

import json
from pathlib import Path

from jobs import chunk_ingest, keyword_index
from quillgraph.plans.ranking_queries import BM25, tokens
from quillgraph.plans.registry import query, shared
from quillgraph.session import importable


def settings(name: str) -> dict:
    return json.loads((Path(chunk_ingest.__file__).parent / f"{name}.json").read_text())


_LICENCES = settings("chunk_ingest")["licences"]
_OPEN = ", ".join(f"'{s}'" for s, x in _LICENCES.items() if x.lower() in ("public_domain", "cc0", "cc-by-4.0"))

#: Chunks by a recursion over each document's paragraphs, as in the packing query, with their first and last paragraph.
CHUNKS = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(lang, 'und') AS lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents),
p AS (SELECT *, list_transform(l, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''))) AS c FROM d WHERE doc_id IS NOT NULL AND len(l) > 0),
w AS (SELECT doc_id, c, 1 AS i, 0::BIGINT AS buf, 0 AS f, []::STRUCT(f INT, l INT, n BIGINT)[] AS done FROM p UNION ALL
 SELECT doc_id, c, i + 1, CASE WHEN buf > 0 AND buf + c[i] > 533 AND buf >= 106 THEN c[i] WHEN buf + c[i] >= 533 THEN 0 ELSE buf + c[i] END,
  CASE WHEN buf > 0 AND buf + c[i] > 533 AND buf >= 106 THEN i WHEN buf > 0 THEN f ELSE i END,
  CASE WHEN buf > 0 AND buf + c[i] > 533 AND buf >= 106 THEN list_append(done, {{'f': f, 'l': i - 1, 'n': buf}}) WHEN buf + c[i] >= 533 THEN list_append(done, {{'f': CASE WHEN buf > 0 THEN f ELSE i END, 'l': i, 'n': buf + c[i]}}) ELSE done END
 FROM w WHERE i <= len(c)),
e AS (SELECT doc_id, CASE WHEN buf > 0 THEN list_append(done, {{'f': f, 'l': i - 1, 'n': buf}}) ELSE done END AS done FROM w WHERE i = len(c) + 1),
x AS (SELECT doc_id, unnest(done) AS k, generate_subscripts(done, 1) AS chunk FROM e),
m AS (SELECT x.doc_id, chunk, lang, source, k.n AS words, sha256(array_to_string(l[k.f:k.l], chr(10))) AS digest FROM x JOIN p USING (doc_id)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, chunk) AS r FROM m) WHERE r = 1),
bad AS (SELECT doc_id, CASE WHEN doc_id IS NULL THEN 'no id' ELSE 'no words' END AS reason FROM d WHERE doc_id IS NULL OR len(l) = 0)"""


@query("job1_chunk_ingest", f"""{CHUNKS} SELECT 'chunk' AS kind, 0::BIGINT AS batch, doc_id, chunk::INT AS chunk, lang, words::INT AS words, source IN ({_OPEN}) AS redistribute, digest AS detail, NULL::BIGINT AS n FROM u
UNION ALL SELECT 'refused', 0, doc_id, NULL, NULL, NULL, NULL, reason, NULL FROM bad
UNION ALL SELECT 'manifest', 0, NULL, NULL, NULL, NULL, NULL, name, n FROM (SELECT 'documents' AS name, count(*) AS n FROM d UNION ALL SELECT 'made', count(*) FROM m UNION ALL SELECT 'chunks', count(*) FROM u UNION ALL SELECT 'refused', count(*) FROM bad)""")
def job1_chunk_ingest(spark, sf_dir):
    """Documents to licensed chunks by a file stream; the second run finds nothing new."""
    importable(spark)
    base = shared(spark, "job1")
    for _ in range(2):
        chunk_ingest.run(spark, f"{sf_dir}/documents.parquet", f"{base}/out", f"{base}/checkpoint", **settings("chunk_ingest"))
    return chunk_ingest.output(spark, f"{base}/out")


@query("job2_keyword_index", f"""WITH {BM25}, a AS (SELECT query_id, id, coalesce(lang, 'und') AS lang, round(score, 3) AS score, rank FROM b JOIN documents ON doc_id = id WHERE rank <= 10)
SELECT 'answer' AS part, query_id, id, NULL AS token, lang, NULL::BIGINT AS n, score, rank::INT AS rank FROM a
UNION ALL SELECT 'term', NULL, NULL, token, NULL, count(DISTINCT id), NULL, NULL FROM (SELECT doc_id AS id, unnest({tokens('text')}) AS token FROM documents) GROUP BY token
UNION ALL SELECT 'documents', NULL, NULL, NULL, coalesce(lang, 'und'), count(*), NULL, NULL FROM documents GROUP BY 5
UNION ALL SELECT 'answers', NULL, NULL, NULL, l.lang, count(a.id), NULL, NULL FROM (SELECT DISTINCT coalesce(lang, 'und') AS lang FROM documents) l LEFT JOIN a ON a.lang = l.lang GROUP BY l.lang""")
def job2_keyword_index(spark, sf_dir):
    """An index of all documents and the answers to all questions, written twice."""
    importable(spark)
    out = f"{shared(spark, 'job2')}/out"
    for _ in range(2):
        keyword_index.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, **settings("keyword_index"))
    return keyword_index.output(spark, out)
