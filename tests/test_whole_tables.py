"""Queries over whole tables: the registered SQL without its row cuts, on tables that are larger than the cuts."""

import duckdb
import pytest
from test_queries import TABLES, rows

from quillspark.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def held(spark, duck, name, *changes):
    sql = catalogue.ORACLES[name]
    for old, new in changes:
        sql = sql.replace(old, new)
    df, want = catalogue.QUERIES[name](spark, SF), duck.execute(sql)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", ["schema_checks", "semantic_checks", "cross_validate", "route_decision", "trigger_counts", "shadow_histogram"])
def test_every_order(spark, duck, name):
    assert duck.execute("select max(o_orderkey) from orders").fetchone()[0] >= 5000
    held(spark, duck, name, (" WHERE o_orderkey < 5000", ""))


@pytest.mark.parametrize("name, filtered", [("divergence", " WHERE l_orderkey % 50 = 0"), ("normalize_units", " WHERE l_orderkey % 100 = 0")])
def test_every_line_item(spark, duck, name, filtered):
    held(spark, duck, name, (filtered, ""))


def test_every_event_type(spark, duck):
    kinds = [k for (k,) in duck.execute("select distinct event_type from events").fetchall()]
    df = catalogue.QUERIES["pivot_period_label"](spark, SF)
    assert sorted(df.columns) == sorted(["day", *kinds]) and len(kinds) > 3
    want = duck.execute("select cast(ts as date) as day, event_type, round(max(value), 2) from events group by all").fetchall()
    got = [(r.day, k, r[k]) for r in df.collect() for k in kinds if r[k] is not None]
    assert rows(["a", "b", "c"], got) == rows(["a", "b", "c"], want)


def test_every_part(spark, duck):
    n = duck.execute("select count(*) from part").fetchone()[0]
    assert n > 200
    held(spark, duck, "peers_resolve", ("p_partkey < 200", "true"), ("% 200", f"% {n}"))


@pytest.mark.parametrize("name", ["triple_validate", "triple_dedup", "metric_link", "entity_search", "graph_analytics", "graph_by_ticker", "degree_topn", "triple_evidence"])
def test_chunks_grow(spark, duck, name):
    customers, suppliers = (duck.execute(f"select count(*) from {t}").fetchone()[0] for t in ("customer", "supplier"))
    held(spark, duck, name, ("c_custkey % 100", f"c_custkey % {customers * 2 // 3}"), ("s_suppkey % 10)", f"s_suppkey % {suppliers})"))


def test_no_valid_triple_lost(spark, duck):
    """Customers and suppliers fill no chunk to its limit; the 25 nations share one chunk, where 8 stay."""
    sql = catalogue.ORACLES["triple_validate"]
    valid = duck.execute(sql[: sql.index(" SELECT id, chunk_id")] + " SELECT count(*) FROM valid WHERE ticker <> 'WORLD'").fetchone()[0]
    assert catalogue.QUERIES["triple_validate"](spark, SF).count() == valid + 8
