"""Every query of the graph engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from lattica.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df, columns):
    def plain(x):
        x = x.item() if hasattr(x, "item") else x
        return f"{x + 0.0:.4f}" if isinstance(x, float) else repr(x)

    return sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert rows(got, columns) == rows(want, columns)


def test_master_table_is_whole_and_sorted(spark, duck):
    got = [(r["dataset"], r["model"], r["method"], r["run"]) for r in QUERIES["C10_master_table"](spark, DATA).collect()]
    assert len(got) == duck.sql("SELECT count(*) FROM orders").fetchall()[0][0] > 500 and got == sorted(got)


def test_replaced_bundle_has_all_nodes_and_edges(spark):
    from lattica.sources.graphs import load_graph

    nodes, edges = load_graph(spark, DATA, "gp")
    got = QUERIES["P07_replaced_bundle"](spark, DATA)
    assert sorted(r["u"] for r in got.filter("kind = 'node' and split <> ''").collect()) == sorted(r["node"] for r in nodes.collect())
    want = sorted(map(tuple, edges.select("u", "v").collect()))
    assert sorted(map(tuple, got.filter("kind = 'edge' and weight > 0").select("u", "v").collect())) == want and max(u for u, _ in want) >= 50


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
