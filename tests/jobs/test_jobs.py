"""The jobs: growing input, reruns, failures midway, and their command lines."""

import json
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import chunk_ingest, keyword_index
from quillgraph.operators import postings

ROOT = Path(__file__).resolve().parents[2]
LICENCES = {"a": "CC0", "b": "CC-BY-NC-4.0"}


def rows_of(df):
    return sorted(map(str, df.collect()))


def documents(spark, rows, path):
    spark.createDataFrame(rows, chunk_ingest.DOCUMENT).coalesce(1).write.mode("append").parquet(path)


def paragraphs(rng, n):
    return "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(1, 300))) for _ in range(n))


def expected_chunks(text, target=533, least=106):
    """Greedy packing in plain Python."""
    out, open_, words = [], [], 0
    for line in [x for x in text.split("\n") if x.split()]:
        n = len(line.split())
        if words and words + n > target and words >= least:
            out.append(open_)
            open_, words = [line], n
        elif words + n >= target:
            out.append([*open_, line])
            open_, words = [], 0
        else:
            open_, words = [*open_, line], words + n
    return ["\n".join(c) for c in [*out, open_] if c]


def test_chunk_ingest_takes_only_what_is_new(spark, tmp_path):
    rng = random.Random(1)
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("documents", "out", "mark"))
    first = [(k, paragraphs(rng, rng.randint(1, 12)), "en" if k % 2 else None, "ab"[k % 2], 1) for k in range(30)]
    first += [(None, "no id", "en", "a", 1), (50, " \n ", "en", "a", 1), (51, None, "en", "zz", 1), (52, first[3][1], "en", "b", 1)]
    documents(spark, first, source)
    n = chunk_ingest.run(spark, source, out, mark, LICENCES)
    assert (n["documents"], n["refused"]) == (34, 3)
    after_first = rows_of(chunk_ingest.output(spark, out))
    assert chunk_ingest.run(spark, source, out, mark, LICENCES) == {}
    assert rows_of(chunk_ingest.output(spark, out)) == after_first  # nothing new, nothing changed
    more = [(60, first[5][1], "de", "a", 1), (61, paragraphs(rng, 4), "de", "a", 1), (2, paragraphs(rng, 3), "en", "q", 1)]
    documents(spark, more, source)
    n = chunk_ingest.run(spark, source, out, mark, LICENCES)
    assert n["documents"] == 3
    whole = chunk_ingest.output(spark, out)
    assert set(after_first) <= set(rows_of(whole)) and whole.where("batch = 1 AND kind = 'manifest'").count() == 4
    # every text once, with the first of its documents, against plain Python
    got = {(r["digest"], r["doc_id"], r["chunk"], r["redistribute"], r["license"], r["batch"]) for r in spark.read.schema(chunk_ingest.CHUNK).parquet(f"{out}/chunks").collect()}
    want, seen = set(), set()
    import hashlib

    for batch, rows in enumerate([first, more]):
        for doc, text, _, src, _ in sorted((r for r in rows if r[0] is not None and (r[1] or "").split()), key=lambda r: r[0]):
            for k, c in enumerate(expected_chunks(text), 1):
                h = hashlib.sha256(c.encode()).hexdigest()
                if h not in seen:
                    seen.add(h)
                    lic = LICENCES.get(src, "unknown")
                    want.add((h, doc, k, lic == "CC0", lic, batch))
    assert got == want and len(got) > 30


def test_chunk_ingest_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("documents", "out", "mark"))
    documents(spark, [(k, paragraphs(rng, 5), "en", "a", 1) for k in range(8)], source)
    chunk_ingest.run(spark, source, out, mark, LICENCES)
    documents(spark, [(k, paragraphs(rng, 5), "en", "a", 1) for k in range(4, 12)], source)
    write = chunk_ingest._write

    def failing(df, path, *parts):
        if path.endswith("quarantine"):
            raise RuntimeError("lost")
        write(df, path, *parts)

    monkeypatch.setattr(chunk_ingest, "_write", failing)
    with pytest.raises(Exception, match="lost"):
        chunk_ingest.run(spark, source, out, mark, LICENCES)  # chunks of batch 1 are there, the mark isn't
    monkeypatch.setattr(chunk_ingest, "_write", write)
    assert chunk_ingest.run(spark, source, out, mark, LICENCES)["documents"] == 8
    once = rows_of(chunk_ingest.output(spark, out))
    # the same batch once more: as if only the mark had been lost
    for f in (tmp_path / "mark" / "commits").glob("*1*"):
        f.unlink()
    assert chunk_ingest.run(spark, source, out, mark, LICENCES)["documents"] == 8
    assert rows_of(chunk_ingest.output(spark, out)) == once


def test_chunk_ingest_in_several_batches_keeps_each_text_once(spark, tmp_path):
    rng = random.Random(3)
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("documents", "out", "mark"))
    same = paragraphs(rng, 6)
    for k in range(4):
        documents(spark, [(k, same, "en", "a", 1), (100 + k, paragraphs(rng, 2), "en", "a", 1)], source)
    n = chunk_ingest.run(spark, source, out, mark, LICENCES, files_per_batch=1)
    chunks = spark.read.schema(chunk_ingest.CHUNK).parquet(f"{out}/chunks")
    assert n["documents"] == 8 and chunks.select("batch").distinct().count() == 4
    assert chunks.count() == chunks.select("digest").distinct().count() == n["chunks"] < n["made"]


def test_keyword_index_reruns_and_empty_tables(spark, sf_dir, tmp_path):
    out = f"file://{tmp_path}/out"
    a = keyword_index.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, k=5)
    once = rows_of(keyword_index.output(spark, out))
    assert keyword_index.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out, k=5) == a
    assert rows_of(keyword_index.output(spark, out)) == once and a["answers"] > 0
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}")
    n = keyword_index.run(spark, f"file://{tmp_path}/documents", f"file://{tmp_path}/benchmark", f"file://{tmp_path}/none")
    assert n == {"documents": 0, "questions": 0, "answers": 0} and keyword_index.output(spark, f"file://{tmp_path}/none").count() == 0


def test_command_line(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/documents.parquet", tmp_path / "documents.parquet")
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"licences": LICENCES, "out": f"{tmp_path}/out", "documents": "overridden"}))
    paths = ["--documents", str(tmp_path / "documents.parquet"), "--checkpoint", f"{tmp_path}/mark"]
    said = subprocess.run([sys.executable, "-m", "jobs.chunk_ingest", "--config", str(config), *paths], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0 and "read 200 documents" in said.stderr, said.stderr[-2000:]
    assert spark.read.parquet(f"{tmp_path}/out/chunks").count() > 100
    bad = subprocess.run([sys.executable, "-m", "jobs.keyword_index"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert bad.returncode == 2 and "no path for" in bad.stderr


def brute_bm25(docs, queries, k, k1=1.2, b=0.75):
    import math

    n, mean = len(docs), sum(len(t) for t in docs.values()) / len(docs)
    df = {}
    for t in docs.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, words in queries.items():
        s = {}
        for w in set(words):
            for i, t in docs.items():
                if (tf := t.count(w)) > 0:
                    s[i] = s.get(i, 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
        out[q] = [(i, round(x, 6)) for i, x in sorted(s.items(), key=lambda r: (-round(r[1], 6), r[0]))[:k]]
    return out


@pytest.mark.parametrize(("segment", "block", "k"), [(65_536, 128, 10), (40, 4, 3), (7, 2, 1)])
def test_block_max_search_is_exact_and_skips(spark, tmp_path, segment, block, k):
    rng = random.Random(segment)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    docs = {i: [rng.choice(common) for _ in range(rng.randint(0, 60))] + [rng.choice(rare) for _ in range(rng.randint(0, 5))] for i in range(300)}
    queries = {q: [rng.choice(rare) for _ in range(3)] + [rng.choice(common) for _ in range(rng.randint(0, 4))] + ["unknown"] for q in range(40)} | {90: [], 91: ["unknown"], 92: common}
    index = postings.build(spark.createDataFrame(list(docs.items()), "id long, tokens array<string>"), f"file://{tmp_path}/i", segment=segment, block=block)
    q = spark.createDataFrame(list(queries.items()), "query_id long, tokens array<string>")
    got = {}
    for r in postings.search(index, q, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    want = {q: x for q, x in brute_bm25(docs, queries, k).items() if x}
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a - b) < 2e-6 for q in got for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    # of all pairs a few are scored in full; before the sum over read blocks was a filter, it was most of those that share a rare word
    assert postings.candidates(index, q.where("query_id < 40"), k)[1].count() < 0.05 * 40 * 300
    read = postings.plan(index, q, k)[1].groupBy("read").agg(F.sum(F.size("ids")).alias("n")).collect()
    n = {r["read"]: r["n"] for r in read}
    assert n[False] > 1000  # postings of weak tokens, and of blocks that can't reach the threshold, are never read
    again = postings.search(postings.opened(spark, f"file://{tmp_path}/i"), q, k)
    assert again.count() == sum(map(len, got.values()))


def test_tokens_are_counted_within_their_document(spark):
    rng = random.Random(5)
    docs = {i: [f"t{rng.randrange(9)}" for _ in range(rng.randint(0, 40))] for i in range(50)} | {90: None, 91: [], 92: ["one"], 93: ["b", "a", "b"]}
    got = {r["id"]: (r["dl"], dict(zip(r["tokens"], r["tfs"], strict=True)), r["tokens"]) for r in postings.counted(spark.createDataFrame(list(docs.items()), "id long, tokens array<string>")).collect()}
    for i, t in docs.items():
        t = t or []
        assert got[i] == (len(t), {w: t.count(w) for w in t}, sorted(set(t)))


def test_a_search_shuffles_no_document_and_opens_blocks_after_their_shuffle(spark, tmp_path):
    docs = [(i, [f"w{i % 7}", f"w{i % 7}", f"v{i % 11}"]) for i in range(200)]
    index = postings.build(spark.createDataFrame(docs, "id long, tokens array<string>"), f"file://{tmp_path}/i")
    assert index.docs.agg(F.sum(F.size("tokens"))).first()[0] == 400  # two rows a document are shuffled, not three
    queries = spark.createDataFrame([(1, ["w1", "v2"]), (2, ["w3"])], "query_id long, tokens array<string>")
    terms, pairs = postings.candidates(index, queries, 2)
    rows = postings._scored(index, pairs, terms)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    read = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    shuffled = next(k for k, line in enumerate(read) if "RepartitionByExpression [query_id" in line)
    opened = next(k for k, line in enumerate(read) if "Generate explode(arrays_zip(ids" in line)
    assert opened < shuffled  # the plan's root is its first line


def test_many_pairs_and_many_terms_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    docs = {i: [f"w{i % 7}", f"w{i % 5}", f"v{i % 11}"] for i in range(120)}
    queries = {q: [f"w{q % 7}", f"v{q % 11}"] for q in range(9)}
    index = postings.build(spark.createDataFrame(list(docs.items()), "id long, tokens array<string>"), f"file://{tmp_path}/i")
    q = spark.createDataFrame(list(queries.items()), "query_id long, tokens array<string>")
    few = rows_of(postings.search(index, q, 3))
    monkeypatch.setattr(postings, "MOST_PAIRS", 0)
    assert rows_of(postings.search(index, q, 3)) == few
    monkeypatch.setattr(postings, "MOST_TERMS", 0)
    assert rows_of(postings.search(index, q, 3)) == few and len(few) == 27
