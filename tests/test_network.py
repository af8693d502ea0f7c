"""Operators of the trade network on hand-made tables with results worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom.functions import scalar
from flowloom.operators import edges, features, graph, indicators, maintenance, ports, traversal
from flowloom.sources import readers

MATRIX = "V1,AAA_X,AAA_Y,BBB_X,AAA_HFCE,OUT\nAAA_X,10,0,5,7,22\nAAA_Y,2,1e-12,bad,0,3\nBBB_X,-4,3,,1,0\nVA,6,1,1,,\n"


@pytest.fixture
def matrix(spark, tmp_path):
    (tmp_path / "1998_SML.csv").write_text(MATRIX)
    return readers.read_icio(spark, str(tmp_path / "1998_SML.csv"))


def triples(df):
    return sorted((r.source, r.target, r.value) for r in df.collect())


def test_melts(matrix, spark, tmp_path):
    wide, columns = matrix
    assert columns == ["AAA_X", "AAA_Y", "BBB_X"]
    assert triples(edges.melt_rectangular(wide, "V1", columns)) == sorted([("AAA_X", "AAA_X", 10), ("AAA_X", "BBB_X", 5), ("AAA_Y", "AAA_X", 2), ("BBB_X", "AAA_X", -4), ("BBB_X", "AAA_Y", 3), ("VA", "AAA_X", 6), ("VA", "AAA_Y", 1), ("VA", "BBB_X", 1)])
    assert triples(edges.melt_square(wide, "V1", columns)) == sorted([("AAA_X", "AAA_X", 10), ("AAA_X", "BBB_X", 5), ("AAA_Y", "AAA_X", 2), ("AAA_Y", "AAA_Y", 1e-12), ("BBB_X", "AAA_Y", 3)])
    assert triples(edges.melt_square(wide, "V1", columns, 3)) == [("AAA_X", "AAA_X", 10), ("AAA_X", "BBB_X", 5), ("BBB_X", "AAA_Y", 3)]
    years = readers.read_icio_years(spark, str(tmp_path / "*_SML.csv")).collect()
    assert {r.year for r in years} == {1998} and len(years) == 5
    found = {r.id: r for r in edges.vertices(edges.matrix_labels(wide, "V1", columns)).collect()}
    assert set(found) == {"AAA_X", "AAA_Y", "BBB_X", "VA"} and (found["VA"].country, found["VA"].sector) == ("VA", "VA")


def test_column_choice_and_missing_files(spark, tmp_path):
    assert edges.sector_columns(["SOUTH_A01", "A_OUT", "A_B01", "TOTAL"]) == ["A_B01"]
    assert edges.sector_columns(["SOUTH_A01", "A_OUT", "A_B01", "TOTAL"], exact=True) == ["SOUTH_A01", "A_B01"]
    with pytest.raises(Exception):
        readers.read_icio(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_icio(spark, str(tmp_path / "x.csv"))


def test_scalars(spark):
    row = spark.createDataFrame([("USA_A01_02", "ROW", "NaN", "7.5", 0.0)], "a string, b string, n string, v string, z double").select(
        scalar.country(F.col("a")), scalar.sector(F.col("a")), scalar.sector_token(F.col("a")), scalar.sector(F.col("b")), scalar.sector_token(F.col("b")), scalar.number(F.col("n")), scalar.number(F.col("v")),
        scalar.growth(F.lit(1.0), F.col("z")), scalar.dead_sign(F.lit(-1e-3), 1e-3), scalar.dead_sign(F.lit(9e-4), 1e-3), scalar.percent_text(F.lit(0.1234)), scalar.percent_text(F.lit(float("nan"))), scalar.month_name(F.lit("09")), scalar.unwrapped(F.array(F.lit("q"))), scalar.clip(F.lit(5.0), -1, 1),
    ).first()
    assert tuple(row) == ("USA", "A01_02", "A01", "ROW", "UNK", None, 7.5, 0.0, -1.0, 0.0, "12.34%", "N/A", "Sep", "q", 1.0)


YEARS = [(1, "A_1", "B_1", 100.0), (2, "A_1", "B_1", 100.0), (3, "A_1", "B_1", 80.0), (1, "A_1", "C_1", 100.0), (2, "A_1", "C_1", 100.0), (3, "A_1", "C_1", 90.0), (2, "B_1", "C_1", 50.0), (3, "B_1", "C_1", 10.0), (1, "C_1", "A_1", 10.0), (2, "C_1", "A_1", 10.0), (1, "B_1", "A_1", 20.0), (3, "B_1", "A_1", 30.0)]


@pytest.fixture
def yearly(spark):
    return spark.createDataFrame(YEARS, "year int, source string, target string, value double")


def test_labels(yearly):
    got = {(r.source, r.target): r for r in features.label_trade_drops(yearly).where("year = 2").collect()}
    want = {("A_1", "B_1"): (True, -0.2, 1, 0), ("A_1", "C_1"): (True, -0.1, 0, 0), ("B_1", "C_1"): (False, 0, 0, 0), ("C_1", "A_1"): (True, -1, 1, 1), ("B_1", "A_1"): (False, 0, 0, 0)}
    assert {k: (r.is_established, pytest.approx(r.pct_change), r.y_drop, r.y_disappear) for k, r in got.items()} == want
    assert got["B_1", "C_1"].is_new_edge and got["B_1", "A_1"].value_t == 0 and not got["B_1", "A_1"].is_new_edge
    first = features.label_trade_drops(yearly).where("year = 1").collect()
    assert len(first) == 4 and all(r.is_new_edge and not r.y_drop for r in first)
    assert features.label_trade_drops(yearly).where("year = 3").count() == 0


def test_node_and_edge_features(yearly):
    n = {(r.year, r.node): r for r in features.node_features(yearly).collect()}
    assert n[1, "A_1"].out_strength_growth is None and n[2, "B_1"].out_strength_growth == pytest.approx(1.5)
    assert n[3, "C_1"].out_strength == 0 and n[3, "C_1"].out_strength_growth == 0  # lost all its outflow
    assert n[2, "C_1"].in_degree == 2 and n[2, "C_1"].in_strength_lag1 == pytest.approx(math.log1p(100))
    e = features.edge_features(yearly)
    for side in ("target", "source"):
        assert all(r.s == pytest.approx(1) for r in e.groupBy("year", side).agg(F.sum(f"share_{side}").alias("s")).collect())
    r = e.where("year = 2 AND source = 'B_1'").first()
    assert r.edge_growth == 0 and r.log_value_lag1 == 0


def test_cleaning_and_scaling(spark, yearly):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1000.0), (1, 1000.0, 0.0)], "year int, value_t double, value_t1 double")
    assert features.clean_edge_values(rows).count() == 1
    capped = features.clean_edge_values(rows, 3.0, "cap").collect()
    assert [r.valid for r in capped] == [True, False, False] and capped[1].value_t1 == pytest.approx(2 * math.exp(3) - 1)
    with pytest.raises(ValueError):
        features.clean_edge_values(rows, mode="other")
    z = features.standardize(yearly.withColumn("k", F.lit(5.0)), ["value", "k"])
    for r in z.groupBy("year").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max("k").alias("k")).collect():
        assert r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1) and r.k == 0


def test_graph_assembly(yearly):
    nodes, links = features.build_graph(yearly, 1)
    assert {r.year for r in links.collect()} == {1, 2} and all(len(r.features) == 5 for r in links.collect())
    assert {(r.year, r.node) for r in nodes.collect()} == {(y, x) for y in (1, 2) for x in ("A_1", "B_1", "C_1")} and nodes.where("year = 2").first().features[-1] == pytest.approx(1 / 20)


FLOWS = [("S", "A", 10.0), ("A", "B", 6.0), ("B", "S", 4.0), ("A", "C", 0.5), ("C", "D", 9.0), ("E", "S", 3.0)]


def test_cascade_and_distance(spark):
    rows = spark.createDataFrame(FLOWS, "source string, target string, value double")
    got = traversal.simulate_disruption(rows, "S", 0.2, 3, 1.0)
    assert sorted((r.degree, r.source, r.target) for r in got.collect()) == [(1, "S", "A"), (2, "A", "B"), (3, "B", "S")]
    s = traversal.cascade_summary(got).first()
    assert (s.total_flows, s.total_original_value) == (3, 20) and s.overall_reduction_pct == pytest.approx(20) and s.total_new_value == pytest.approx(16)
    assert traversal.cascade_summary(traversal.simulate_disruption(rows, "nobody", 0.2)).first().overall_reduction_pct is None
    assert [r.degree for r in traversal.cascade_nested(got).orderBy("degree").collect()] == [1, 2, 3]
    d = traversal.edge_distance(rows, spark.createDataFrame([("S",)], "node string"))
    assert {(r.source, r.target): r.distance for r in d.collect()} == {("S", "A"): 0, ("A", "B"): 1, ("A", "C"): 1, ("B", "S"): 2, ("C", "D"): 2, ("E", "S"): 3}


def test_cascade_is_the_closed_form(spark):
    rng = random.Random(1)
    for _ in range(3):
        pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(25)}
        rows = spark.createDataFrame([(str(a), str(b), 1.0) for a, b in pairs], "source string, target string, value double")
        hops, frontier = {0: 0}, [0]
        while frontier:
            frontier = [b for a in frontier for x, b in pairs if x == a and b not in hops and not hops.update({b: hops[a] + 1})]
        want = sorted((hops[a] + 1, str(a), str(b)) for a, b in pairs if a in hops and hops[a] < 3)
        assert sorted((r.degree, r.source, r.target) for r in traversal.simulate_disruption(rows, "0", 0.5).collect()) == want


def test_graph_queries(spark, yearly):
    nodes = edges.vertices(edges.endpoints(yearly))
    assert graph.node_exists(nodes, "A_1").first().found and not graph.node_exists(nodes, "Z").first().found
    assert graph.node_properties(nodes, "A_1").first().properties["country"] == ["A"]
    two = yearly.where("year = 2")
    assert graph.flow_value(two, "A_1", "B_1").first().value == 100 and graph.flow_value(two, "Z", "B_1").first().value is None
    assert [r.target for r in graph.outgoing_flows(two, "A_1").collect()] == ["B_1", "C_1"] and [r.source for r in graph.incoming_flows(two, "C_1", 60).collect()] == ["A_1"]
    assert [r["rank"] for r in graph.ranked(two, n=2).collect()] == [1, 2] and graph.not_shown(two, 2).first().more == 2
    assert tuple(graph.graph_stats(nodes, yearly).first()) == (3, 12) and tuple(graph.graph_stats(nodes.limit(0), yearly.limit(0)).first()) == (0, 0)
    assert graph.random_node(nodes, 3).first() == graph.random_node(nodes, 3).first()
    assert [r.id for r in graph.existing_ids(nodes, spark.createDataFrame([("A_1",), ("Q",)], "id string")).collect()] == ["A_1"]
    assert graph.query_report(nodes, two, "A_1", "C_1").first().flow == 100


def test_maintenance(spark):
    old = spark.createDataFrame([("a", "l", "b", 1.0)], "source string, label string, target string, value double")
    new = spark.createDataFrame([("a", "l", "b", 9.0), ("a", "l", "c", 2.0), ("a", "l", "c", 2.0)], old.schema)
    keys = ["source", "label", "target"]
    assert [r.value for r in maintenance.insert_if_absent(new, old, keys).collect()] == [2.0]
    assert sorted(r.value for r in maintenance.upsert(new, old, keys).collect()) == [2.0, 9.0]
    nodes = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "id string, country string")
    left, flows = maintenance.clear_partition(nodes, new, "country", "y")
    assert {r.id for r in left.collect()} == {"a", "b"} and [r.target for r in flows.collect()] == ["b"]
    with pytest.raises(ValueError):
        maintenance.clear_partition(nodes, new, None, "y")
    with pytest.raises(ValueError):
        maintenance.clear_partition(nodes, new)
    assert maintenance.clear_partition(nodes, new, confirm=True)[0].count() == 0


def test_ports(spark):
    rows = [("c1", "x", "08", "10"), ("c1", "x", "09", "5"), ("c1", "x", "10", "8"), ("c2", "x", "08", "10"), ("c2", "x", "09", "5"), ("c3", "y", "08", "5"), ("c3", "y", "09", "5"), ("c3", "y", "10", "8"), ("-", "y", "08", "1"), ("-", "y", "09", "1"), ("-", "y", "10", "1"), ("c4", "y", "08", "0"), ("c4", "y", "09", "4"), ("c4", "y", "10", "6"), ("c5", "y", "08", "x"), ("c5", "y", "07", "3")]
    trade = ports.cleaned(spark.createDataFrame([(a, "d", b, m, v) for a, b, m, v in rows], "commodity string, commodity_desc string, cty_code string, month string, value string"))
    wide = ports.by_month(trade)
    assert [r.commodity for r in ports.v_shaped(wide).collect()] == ["c1"]
    s = ports.share(wide).first()
    assert (s.total, s.v_total) == (66, 23) and s.share_pct == pytest.approx(23 / 66 * 100)
    assert {r.month: r.total for r in ports.totals_by_month(trade).collect()} == {"Aug": 25, "Sep": 19, "Oct": 22}
    assert ports.share(wide.limit(0)).first().share_pct == 0


def test_indicators(spark):
    nodes = spark.createDataFrame([(x,) for x in ("AA_1", "AA_2", "BB_1", "CC_1", "TWN_1", "ROW_1", "DD_1")], "id string")
    values = spark.createDataFrame([("AA", 1, "g", 1.0), ("R1", 1, "g", 5.0), ("WLD", 1, "g", 7.0), ("EAS", 1, "g", 9.0), ("X1", 1, "g", 2.0), ("X2", 1, "g", 4.0), ("R1", 1, "other", 1.0)], "country string, year int, code string, value double")
    economies = spark.createDataFrame([("AA", "R1", False), ("BB", "R1", False), ("CC", "R2", False), ("X1", "R1", False), ("X2", "R1", False), ("R1", None, True), ("WLD", None, True), ("EAS", None, True)], "id string, region string, is_aggregate boolean")
    got = {r.country: r.value for r in indicators.fill_indicators(nodes, values, economies, codes=("g",)).collect()}
    assert got == {"AA": 1.0, "BB": 5.0, "CC": 7.0, "TWN": 9.0, "ROW": 3.0, "DD": None}
    wide = indicators.node_indicators(nodes, indicators.fill_indicators(nodes, values.withColumn("code", F.lit("gdp_per_capita")), economies), indicators.CODES)
    assert wide.columns[-1] == "log_gdp_per_capita" and len(wide.columns) == 9 and wide.where("node = 'AA_2'").first().log_gdp_per_capita > 0


def test_readers(spark, tmp_path):
    (tmp_path / "BRN1995ttl.csv").write_text(",A01_02,B05_06,HFCE\nTTL_A01_02,1.0,2.0,3\nTTL_B05_06,4,5,-6\nTTL_INT_FNL,5,7,\nVALU,1,1,0\nOUTPUT,6,8,0\n")
    cells = readers.read_national(spark, str(tmp_path / "*ttl.csv"))
    assert {(r.country, r.year) for r in cells.collect()} == {("BRN", 1995)} and cells.count() == 14
    assert all(abs(r.difference) < 2 for r in readers.national_balance(cells).collect())
    assert {(r.source, r.target, r.value) for r in readers.national_edges(cells).collect()} == {("BRN_A01_02", "BRN_A01_02", 1.0), ("BRN_A01_02", "BRN_B05_06", 2.0), ("BRN_B05_06", "BRN_A01_02", 4.0), ("BRN_B05_06", "BRN_B05_06", 5.0)}
    (tmp_path / "ports.json").write_text('[["E_COMMODITY","E_COMMODITY_SDESC","CTY_CODE","MONTH","ALL_VAL_MO","COMM_LVL"],["01","live","10","08","5","HS2"],["0101","horses","10","09","bad","HS4"]]')
    assert [(r.commodity, r.month, r.value) for r in readers.read_port_trade(spark, str(tmp_path / "ports.json"), "ALL_VAL_MO").collect()] == [("01", "08", 5.0), ("0101", "09", None)]
    assert readers.read_port_trade(spark, str(tmp_path / "ports.json"), "ALL_VAL_MO", level="HS2").count() == 1
    (tmp_path / "ind.csv").write_text("country,code,YR1998,YR1999\nAA,g,1.5,\nBB,g,x,2\n")
    assert sorted((r.country, r.year, r.value) for r in readers.read_indicators(spark, str(tmp_path / "ind.csv")).collect()) == [("AA", 1998, 1.5), ("BB", 1999, 2.0)]
