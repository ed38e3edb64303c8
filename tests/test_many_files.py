"""Sources of one file a document: a task writes many of them."""

import glob

import __spark_entry__  # noqa: F401  registers the queries

from quillgraph.plans import adapter_queries
from quillgraph.plans.registry import QUERIES


def test_tasks_are_fewer_than_files(spark, sf_dir, monkeypatch):
    read, paths = adapter_queries.adapters.brethren_parsed, []
    monkeypatch.setattr(adapter_queries.adapters, "brethren_parsed", lambda spark, path: (paths.append(path), read(spark, path))[1])
    QUERIES["adapter_brethren_parsed"](spark, sf_dir)
    files = [f.rsplit("/", 1)[1] for f in glob.glob(paths[0].removeprefix("file://"))]
    n = adapter_queries.nations(spark, sf_dir).count() + 1
    assert len(files) == n and len({f.split("-")[1] for f in files}) <= 4 < n
