"""Queries that SQL can't express, against plain Python over whole tables."""

import hashlib
import html
import json
import re

from quillgraph.plans.registry import QUERIES

BLOCKS = "p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|main|nav|blockquote|title|body|head|html|dd|dt"


def plain(page: str) -> str:
    """Visible text by regular expressions alone."""
    page = re.sub(r"(?s)<!--.*?-->", "", page)
    page = re.sub(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", "", page)
    page = re.sub(rf"(?i)</?({BLOCKS})\b[^>]*>", " ", page)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "", page)).split())


def main_part(page: str) -> str | None:
    found = re.search(r"(?is)<article\b[^>]*>(.*?)</article>", page)
    return found[1] if found else None


def test_visible_text(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["html_text"](spark, sf_dir).collect()}
    assert len(got) == len(pages) > 20
    for k, page in pages.items():
        assert got[k] == (None if page is None else plain(page)), k


def test_main_part_and_sections(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    main = {r["page_id"]: r for r in QUERIES["main_content"](spark, sf_dir).collect()}
    parts = {}
    for r in QUERIES["page_sections"](spark, sf_dir).collect():
        parts.setdefault(r["page_id"], []).append((r["at"], r["title"], r["text"]))
    seen = 0
    for k, page in pages.items():
        body = main_part(page or "")
        if body is None:
            continue
        seen += 1
        assert main[k]["text"] == plain(body)
        assert main[k]["title"] == plain(re.search(r"(?is)<title>(.*?)</title>", page)[1])
        want = []
        for title, rest in re.findall(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>(.*?)(?=<h[1-6]\b|\Z)", body):
            said = [t for t in map(plain, re.split(r"(?i)</?p\b[^>]*>", re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "", rest))) if t]
            if said and plain(title):
                want.append((plain(title), "\n".join(said)))
        if not any(re.match(r"\D{0,20}\d|[A-Za-z]*\s*[IVXLC]+[.:\s]", t) for t, _ in want):  # numbered titles go by first wins
            assert [(t, x) for _, t, x in sorted(parts.get(k, []))] == want, k
    assert seen > 10


def test_snapshots(spark, sf_dir):
    got = {r["label"]: (r["n"], r["digest"]) for r in QUERIES["snapshot_hash"](spark, sf_dir).collect()}
    for name in ("region", "nation", "labels"):
        rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
        sums = [0] * 8
        for r in rows:
            h = hashlib.sha256(json.dumps(dict(sorted(r.items())), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            for k in range(8):
                sums[k] += int(h[8 * k : 8 * k + 8], 16)
        assert got[name] == (len(rows), hashlib.sha256(".".join(["s", *map(str, sums)]).encode()).hexdigest())


def test_searches_in_blocks(spark):
    """More queries than one broadcast holds give the same as all at once."""
    from quillgraph.operators import retrieval

    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)]
    items = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = items.selectExpr("id AS query_id", "vector")
    whole = retrieval.dense(queries, items, 3).collect()
    before = retrieval.in_blocks.__defaults__
    retrieval.in_blocks.__defaults__ = (20,)
    try:
        parts = retrieval.dense(queries, items, 3).collect()
    finally:
        retrieval.in_blocks.__defaults__ = before
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) == 180


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    import pytest

    from quillgraph.plans import registry

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        registry.shared(Elsewhere, "x")
    assert registry.shared(spark, "x") != registry.shared(spark, "x")
