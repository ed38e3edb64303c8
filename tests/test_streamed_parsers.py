"""Parsers give their rows as they find them, and their sources are sets of whole documents."""

import tracemalloc

import pytest

from quillgraph.plans.registry import QUERIES, SQL
from quillgraph.sources import markup
from tests.test_queries import rows


@pytest.mark.parametrize("name", ["adapter_oshb", "adapter_tei_history", "adapter_josephus"])
def test_sources_are_several_documents(spark, sf_dir, duck, name, monkeypatch):
    from quillgraph.plans import adapter_queries

    written = []
    monkeypatch.setattr(adapter_queries, "DOCUMENT", 64)
    real = adapter_queries.documents
    monkeypatch.setattr(adapter_queries, "documents", lambda *a, **k: written.append(real(*a, **k)) or written[-1])
    got = QUERIES[name](spark, sf_dir)
    assert rows(got.columns, got.collect()) == rows(got.columns, duck.sql(SQL[name]).project(", ".join(got.columns)).fetchall())
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(written[0]).count() > 1


@pytest.mark.parametrize("parse, item", [
    (markup.osis_rows, "<verse osisID='a'><w id='{0}' lemma='5'>word</w></verse>"), (markup.tei_rows, "<div n='{0}'><p>some words</p></div>"),
    (markup.milestone_rows, "<div subtype='section' n='{0}'><p>some words</p></div>"),
])
def test_a_long_document_is_not_held_as_a_tree(parse, item):
    x = ("<x>" + "".join(item.format(k) for k in range(20_000)) + "</x>").encode()
    tracemalloc.start()
    n = sum(1 for _ in parse(x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 8 << 20


def test_rows_leave_in_pieces(spark):
    docs = spark.createDataFrame([(1, "5000"), (2, None), (3, "2")], "id long, x string").coalesce(1)
    got = markup.parsed(docs, "x", lambda x: ({"n": k} for k in range(int(x))), "n int")
    assert got.columns == ["id", "at", "n"] and got.count() == 5002 and got.where("at <> n").isEmpty()
