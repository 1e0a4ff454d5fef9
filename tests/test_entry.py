"""Every query has an oracle, and they agree on small data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratagraph import queries as graph

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_graph_query_has_an_oracle():
    assert set(graph.QUERIES) == set(graph.ORACLE) and set(graph.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["who_calls_api", "find_god_methods", "find_call_chain", "find_modules_overview", "graph_data_path", "graph_diff_counts", "enclosing_functions", "who_calls_api_at_runtime"])
def test_agrees_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    want = con.sql(graph.ORACLE[name])
    columns = sorted(want.columns)
    clean = lambda rows: sorted(str(tuple(r)) for r in rows)
    got = graph.QUERIES[name](spark, DATA).select(*columns).collect()
    assert clean(got) == clean(want.select(*columns).fetchall())
