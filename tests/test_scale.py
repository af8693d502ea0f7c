"""Operators whose groups may be large, against plain Python."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowloom import shared
from flowloom.operators import gnn, maintenance, ports, predictor, quantiles, shocks
from flowloom.sources import readers


def test_medians_are_exact(spark):
    rng = random.Random(1)
    groups = {"a": [rng.gauss(0, 1) for _ in range(5001)], "b": [rng.choice([0.0, 0.0, 1.0, 2.0]) for _ in range(4000)], "c": [3.0], "d": [1.0, 2.0], "e": [None, None], None: [5.0, None, 7.0, 9.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    for lower in (False, True):
        got = {r.k: r.m for r in quantiles.exact_median(rows, ["k"], "v", "m", lower).collect()}
        middle = statistics.median_low if lower else statistics.median
        assert got == {k: (middle([v for v in vs if v is not None]) if any(v is not None for v in vs) else None) for k, vs in groups.items()}
    assert quantiles.exact_median(rows.limit(0), ["k"], "v", "m").count() == 0


def test_exact_samples_are_the_first_by_hash(spark):
    keys = [(g, f"s{i}", f"t{i % 13}") for g, n in ((1, 3000), (2, 40), (None, 5)) for i in range(n)]
    rows = spark.createDataFrame([(*k, 7) for k in keys], "year int, source string, target string, place int").repartition(4)
    size = F.when(F.col("year") == 1, 1234).when(F.col("year") == 2, 100).otherwise(0)
    got = sorted((r.year, r.source, r.target) for r in shocks.exactly(rows, ["year"], ["source", "target"], size, 9).collect())
    hashed = lambda k: hashlib.md5(f"9|{k[1]}|{k[2]}".encode()).hexdigest()
    want = sorted(sorted((k for k in keys if k[0] == 1), key=lambda k: (hashed(k), *k[1:]))[:1234] + [k for k in keys if k[0] == 2])
    assert got == want


def test_the_first_row_stays(spark):
    new = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (1, "c", "q")], "line int, id string, v string")
    old = spark.createDataFrame([(0, "c", "o")], new.schema)
    assert sorted(tuple(r) for r in maintenance.insert_if_absent(new, old, ["id"], ["line"]).collect()) == [(1, "a", "y"), (2, "b", "z")]
    assert sorted(r.v for r in maintenance.upsert(new, old, ["id"], ["line"]).collect()) == ["q", "y", "z"]


def test_rate_falls_on_a_plateau():
    values = iter([1.0, *[0.5] * 12, 2.0, 0.1])
    best, seen = predictor.train_on_plateau(lambda rate, before: (before or 0) + 1, lambda m: next(values), 0.4, rounds=15)
    assert best == 14 and [r for r, _ in seen] == [0.4] * 7 + [0.2] * 6 + [0.1] * 2
    assert len(predictor.train_on_plateau(lambda r, b: 1, lambda m: 0.0, 1.0, rounds=50, patience=15)[1]) == 16


def test_ports_in_one_call(spark, tmp_path):
    rows = [("c1", "x", "08", "10"), ("c1", "x", "09", "5"), ("c1", "x", "10", "8"), ("c2", "x", "08", "10"), ("c2", "x", "09", "5"), ("-", "y", "08", "1")]
    one = ports.analyse(spark.createDataFrame([(c, c, k, m, v) for c, k, m, v in rows], "commodity string, commodity_desc string, cty_code string, month string, value string"), str(tmp_path)).first()
    assert (one.commodities, one.v_commodities, one.total, one.v_total) == (2, 1, 38.0, 23.0)
    read = lambda n, *names: sorted(tuple(r[c] for c in names) for r in spark.read.option("header", True).csv(f"{tmp_path}/{n}").collect())
    assert read("filtered", "commodity", "month", "value") == [("c1", "08", "10.0"), ("c1", "09", "5.0"), ("c1", "10", "8.0"), ("c2", "08", "10.0"), ("c2", "09", "5.0")]
    assert read("v_shape", "commodity", "Aug", "Sep", "Oct") == [("c1", "10.0", "5.0", "8.0")]


def test_economies(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,region,aggregate\nBRA,LCN,false\nWLD,,true\nTWN, ,\n")
    assert [tuple(r) for r in readers.read_economies(spark, str(tmp_path / "e.csv")).collect()] == [("BRA", "LCN", False), ("WLD", None, True), ("TWN", None, False)]


def test_shared_folder_needs_a_name_off_local_masters(spark, monkeypatch):
    class Context:
        master = "spark://a:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_graph_network_by_hand(spark):
    """Two nodes, one flow: layer norm of two numbers gives -1 and 1, so all can be worked out."""
    nodes = spark.createDataFrame([(1, "A_1", [2.0]), (1, "B_1", [4.0])], "year int, node string, features array<double>")
    edges = spark.createDataFrame([(1, "A_1", "B_1", [1.0], 10.0)], "year int, source string, target string, features array<double>, value_t double")
    still = ([0.0, 0.0], [1.0 - gnn.EPS] * 2, [1.0, 1.0], [0.0, 0.0])
    net = gnn.Network(([[1.0, 0.0, 0.0], [0.0, 4.0, 0.0]], [0.0, 0.0], [1.0, 1.0], [0.0, 0.0]), [gnn.Mean([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0], still)], (([[1.0, 0, 0, 0, 0, 0], [0, 0, 1.0, 0, 0, 0]], [0.0, 0.0], [1.0, 1.0], [0.0, 0.0]), ([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0]), ([[1.0, 2.0]], [0.5])), 2.0, 1.0)
    # Encoded: A (1, 0), B (1, 0); B's mean adds A: A (1, 0), B (2, 0). Head sees 1 and 2: (0, 1) after norm and relu.
    assert abs(gnn.forward(nodes, edges, net).first().pred - (2 * (0.5 + 2.0) + 1)) < 1e-3
    # Shocked A is (2, 4): encoded (0, 1); B gets it from A: A (0, 1), B (1, 1). The head sees 0 and 1: (0, 1) again.
    runs = gnn.both_runs(nodes, edges, net, ["A_1", "nowhere"]).first()
    assert abs(runs.baseline_delta - runs.shocked_delta) < 1e-3
    even = gnn.Network(net.encoder, [gnn.Attention([([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0], [0.0, 0.0])] * 2, [0.0, 0.0], still)], net.head, 2.0, 1.0)
    # Even shares: A (1, 0) of itself, B the mean of A and itself (1, 0). The head sees 1 and 1: norm gives 0.
    assert abs(gnn.forward(nodes, edges, even).first().pred - (2 * 0.5 + 1)) < 5e-3  # norms of almost equal numbers are as coarse as eps
