"""The queries do the whole job: no edge and no year is left out."""

import os

import pytest

from flowloom.plans import network, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_distances_of_all_edges(spark):
    want = {(r.source, r.target): r.value for r in network.edges_of(spark, SF).collect()}
    rows = registry.queries()["edge_distance_M9"](spark, SF).collect()
    assert {(r.source, r.target): r.value for r in rows} == want
    level, frontier = {network.NODE: 0, network.OTHER: 0}, {network.NODE, network.OTHER}
    for n in (1, 2):
        frontier = {b for a, b in want if a in frontier} - set(level)
        level |= dict.fromkeys(frontier, n)
    assert all(r.distance == level.get(r.source, 3) for r in rows)
    assert min(want.values()) < network.LARGE


def test_cascade_has_no_floor(spark):
    sf = SF.replace("0.001", "0.01")  # the start sells nothing in the smallest tables
    out = {(r.source, r.target) for r in registry.queries()["cascade_G8"](spark, sf).where("degree = 1").collect()}
    rows = network.edges_of(spark, sf).where(f"source = '{network.NODE}'").collect()
    assert out == {(r.source, r.target) for r in rows} and min(r.value for r in rows) < network.LARGE


@pytest.mark.parametrize("name, kept", [("edge_shock_M1", "all"), ("target_delta_M6", "all"), ("metrics_year_A25", "going on"), ("predictor_ML2", "going on")])
def test_every_year_with_a_successor(spark, name, kept):
    edges = {(r.year, r.source, r.target) for r in network.all_edges(spark, SF).collect()}
    years = {y for y, _, _ in edges}
    want = {e for e in edges if (e[0] + 1 in years if kept == "all" else (e[0] + 1, *e[1:]) in edges)}
    out = registry.queries()[name](spark, SF)
    if "source" in out.columns:
        assert {(r.year, r.source, r.target) for r in out.collect()} == want
    else:
        assert {r.year: r.n_samples for r in out.collect()} == {y: sum(e[0] == y for e in want) for y in {e[0] for e in want}}
    assert {e[0] for e in want} > {1997, 1998, 1999}


def test_years_of_an_empty_sample_count_zero(spark, tmp_path):
    """From 1995 to 1996 both flows grow, so nothing balances them; from 1996 to 1997 one grows, one falls."""
    import datetime

    import duckdb

    values = {(1995, 0): 10.0, (1995, 1): 10.0, (1996, 0): 20.0, (1996, 1): 20.0, (1997, 0): 30.0, (1997, 1): 5.0}
    tables = {
        "customer": ("c_custkey long, c_nationkey int", [(1, 1)]), "supplier": ("s_suppkey long, s_nationkey int", [(1, 2)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp", [(y, 1, datetime.datetime(y, 6, 1)) for y in (1995, 1996, 1997)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double", [(y, p, 1, v, 0.0) for (y, p), v in values.items()]),
    }
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, registry.queries()["balanced_part_M5"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(registry.oracle_sql()["balanced_part_M5"]).fetchall()) == [(1995, 0), (1996, 1)]
