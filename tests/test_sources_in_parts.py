"""Sources that are written in several files, and keys of two kinds."""

import pytest

from quillgraph.plans.registry import QUERIES, SQL
from tests.test_queries import rows


@pytest.mark.parametrize("name", ["adapter_macula_hebrew", "adapter_open_cbgm_3_john", "adapter_vulgate_clementine"])
def test_documents_are_whole_in_every_file(spark, sf_dir, duck, name, monkeypatch):
    from quillgraph.plans import adapter_queries

    monkeypatch.setattr(adapter_queries, "DOCUMENT", 64, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or small tables are written as one file
    try:
        got = QUERIES[name](spark, sf_dir)
        assert rows(got.columns, got.collect()) == rows(got.columns, duck.sql(SQL[name]).project(", ".join(got.columns)).fetchall())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("orders", [[(0, 2, "1-URGENT"), (-1, 2, "1-URGENT"), (5, 3, "2-HIGH")], [(0, 2, "1-URGENT"), (4, None, "1-URGENT")]])
def test_orphans_are_no_orders(spark, tmp_path, orders):
    import duckdb

    spark.createDataFrame([(k,) for k in range(4)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["orphan_check"](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(got.columns, con.sql(SQL["orphan_check"]).fetchall())
