"""Shocks, losses, metrics, counterfactual runs, comparisons, predictors, sinks and streams."""

import math

import pytest
from pyspark.sql import functions as F

from flowloom.operators import counterfactual, experiments, losses, metrics, predictor, shocks
from flowloom.sources import readers, writers
from flowloom.streaming import edges as stream


def rows_of(spark):
    return spark.createDataFrame([(1, f"a{i}", f"b{i % 7}", 10.0, 10.0 * (0.5 + i / 40)) for i in range(40)], "year int, source string, target string, value_t double, value_t1 double")


def test_losses_by_hand(spark):
    two = spark.createDataFrame([(1, 0.1, 0.3, 3.0), (1, -0.2, 0.2, 8.0)], "year int, pred double, target_delta double, value_t double")
    mean = lambda name, **k: two.agg(F.avg(losses.loss(name, F.col("pred"), F.col("target_delta"), **k))).first()[0]
    assert mean("mse") == pytest.approx(0.1) and mean("sign_corrected") == pytest.approx((0.04 + 0.16 * math.e) / 2) and mean("focal") == pytest.approx(0.14)
    assert mean("sign_corrected", alpha=0.0) == pytest.approx(0.1) and mean("hybrid", alpha=0.0, gamma=1.0) == pytest.approx(0.1) and mean("focal", gamma=1.0, boost=1.0) == pytest.approx(0.1)
    w = [2.0 / 2.5, 3.0 / 2.5]
    assert losses.weighted_sign(two, "value_t").first().loss == pytest.approx((0.04 * w[0] + 0.16 * math.e * w[1]) / 2)
    table = losses.compare_losses(two).collect()
    assert len(table) == 6 and table[0].relative == 1 and table[0].direction_acc == 0.5
    with pytest.raises(ValueError):
        losses.loss("huber", F.col("pred"), F.col("target_delta"))


def test_metrics_at_the_edges_of_eps(spark):
    rows = spark.createDataFrame([(1, p, t, 1.0, math.expm1(math.log1p(1.0) + t)) for p, t in [(0.001, 0.001), (-0.001, -0.5), (0.0009, 0.0), (0.5, -0.5), (0.2, 0.2)]], "year int, pred double, target_delta double, value_t double, value_t1 double")
    d = metrics.direction_metrics(rows).first()
    assert d.direction_acc == 0.8 and d.gain_dir_acc == 1 and d.drop_dir_acc == 0.5 and d.drop_f1 == pytest.approx(2 / 3, abs=1e-6)
    s = metrics.sign_distribution(rows).first()
    assert s.target_zero_frac == pytest.approx(0.4) and s.pred_neg_frac == 0
    y = metrics.year_metrics(rows).first()
    assert (y.false_positive, y.false_negative, y.n_samples) == (1, 0, 5)
    r = metrics.regression_metrics(rows).first()
    assert r.rmse == pytest.approx(math.sqrt(r.mse)) and r.r2 < 1


def test_shocks_and_samples(spark):
    rows = shocks.with_target(shocks.edge_shocks(rows_of(spark)))
    assert rows.where("shocked").count() == 14  # the fifteenth falls by 0.15 exactly
    nodes = rows.select("year", F.explode(F.array("source", "target")).alias("node")).distinct()
    assert not any(r.shocked for r in shocks.node_shocks(rows, nodes).where("node LIKE 'b%'").collect())
    n = {r.kind: r["count"] for r in shocks.balanced_sample(rows, seed=1).groupBy("kind").count().collect()}
    assert n["gain"] == n["drop"] == 19 and n["neutral"] == 1
    assert shocks.balanced_sample(rows, seed=1).collect() == shocks.balanced_sample(rows, seed=1).collect()
    half = shocks.shock_sample(rows, 0.5, 2)
    assert half.count() == 20 and half.where("shocked").count() == rows.where("shocked").count()
    trials = shocks.shock_trials(nodes.select("node"), 4, seed=3).groupBy("trial").count().collect()
    assert len(trials) == 4 and all(5 <= r["count"] <= 10 for r in trials)


def test_counterfactual(spark):
    rows = spark.createDataFrame([("USA_A01_02", "ROW", 10.0, 0.0, -0.175), ("ROW", "USA_A01_02", 10.0, 0.0, 0.0), ("X_1", "Y_1", 5.0, 0.1, 0.1), ("USA_A01_02", "USA_A01_02", 1.0, 0.0, -0.1), ("X_1", "USA_A01_02", 1.0, 0.0, -0.1)], "source string, target string, value_t double, baseline_delta double, shocked_delta double")
    out = counterfactual.simulate_shock(rows, ["USA_A01_02"], 0.5)
    got = {(r.source, r.target): r for r in out.collect()}
    first = got["USA_A01_02", "ROW"]
    assert first.edge_type == "direct_outgoing" and first.source_sector == "A01" and first.target_sector == "UNK" and first.effect_log == pytest.approx(-0.5) and first.shocked_value_t1 == pytest.approx(11 * math.exp(-0.5) - 1)
    assert got["USA_A01_02", "USA_A01_02"].edge_type == "internal" and got["X_1", "USA_A01_02"].edge_type == "direct_incoming" and got["X_1", "Y_1"].absolute_change == 0
    s = counterfactual.shock_summary(out, ["USA_A01_02"], 0.5).first()
    assert (s.total_edges, s.direct_outgoing, s.direct_incoming, s.indirect, s.magnitude) == (5, 1, 2, 1, -0.5)
    assert counterfactual.direct_blocks(out).count() == 3 and counterfactual.indirect_block(out).first().over_1_pct == 0
    assert counterfactual.impacts(out).where("level = 'country'").count() == 3
    nodes = spark.createDataFrame([("X_1",)], "id string")
    assert counterfactual.valid_shocks(nodes, ["X_1", "Q"]).count() == 1
    with pytest.raises(ValueError):
        counterfactual.valid_shocks(nodes, ["Q"])


def test_decay(spark):
    rows = spark.createDataFrame([(2008, 1, 0, -0.1), (2008, 1, 1, -0.02), (2008, 1, 1, -0.04), (2008, 2, 1, -0.06), (2003, 1, 1, -0.01)], "year int, trial int, distance int, effect double")
    d = {(r.year, r.trial, r.distance): r for r in counterfactual.hop_decay(rows).collect()}
    assert d[2008, 1, 1].median_effect == -0.04 and d[2008, 1, 1].pct_drops == 100 and d[2008, 1, 0].std_effect is None
    by_year = counterfactual.over_trials(counterfactual.hop_decay(rows))
    assert by_year.where("year = 2008 AND distance = 1").first().median_effect == pytest.approx(-0.05)
    assert counterfactual.crisis_and_boom(by_year).first().verdict == "stronger in crisis"
    v = counterfactual.verdicts(counterfactual.over_years(by_year)).first()
    assert v.responds and v.propagates and v.ratio == pytest.approx(0.275)


def test_comparison_of_results(spark, tmp_path):
    for name, acc, rmse in (("mse", 0.79, 0.27), ("focal", 0.66, 0.29), ("none", None, None)):
        (tmp_path / f"{name}_model").mkdir()
        test = {"direction_acc": acc, "rmse": rmse, "smape": 23.04} if acc else {}
        (tmp_path / f"{name}_model" / "results.json").write_text(readers.as_result_json(test, {"r2": 0.3}, 20, {"lr": 0.002}))
    rows = readers.read_results(spark, str(tmp_path / "*_model" / "results.json"))
    table = {r.loss: r for r in experiments.metric_table(rows).collect()}
    assert table["mse"].direction_acc == "79.00%" and table["mse"].smape == "23.0%" and table["none"].rmse == "N/A" and table["mse"].best_epoch == "20"
    means = rows.select(F.col("loss").alias("model"), "test_metrics.*")
    best = {r.metric: r.model for r in experiments.best_models(means, ("direction_acc", "rmse")).collect()}
    assert best == {"direction_acc": "mse", "rmse": "mse"}
    assert experiments.plotted(rows).where("loss = 'none'").first().r2 == 0


def test_predictors(spark, tmp_path):
    rows = shocks.with_target(rows_of(spark)).withColumn("x", F.col("target_delta") * 2 + 1)
    model = predictor.EdgeRegression(["x"]).fit(rows)
    assert model.predict(rows).agg(F.max(F.abs(F.col("pred") - F.col("target_delta")))).first()[0] < 0.05
    model.save(str(tmp_path / "m"))
    assert predictor.EdgeRegression(["x"]).load(str(tmp_path / "m")).predict(rows).count() == 40
    with pytest.raises(ValueError):
        predictor.EdgeRegression(["x"]).predict(rows)
    values = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (1, "c", 0.0)], "year int, node string, v double")
    links = spark.createDataFrame([(1, "a", "c"), (1, "b", "c"), (1, "c", "a")], "year int, source string, target string")
    got = {r.node: r.v_hop1 for r in predictor.neighbour_means(links, values, ["v"]).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 3.0}


def test_patience():
    values = iter([0.1, 0.3, 0.2, 0.25, 0.9])
    best, seen = predictor.train_with_patience(lambda r: r, lambda m: next(values), [1, 2, 3, 4, 5], patience=2)
    assert best == 2 and seen == [0.1, 0.3, 0.2, 0.25]


def test_sinks(spark, tmp_path):
    rows = rows_of(spark)
    writers.write_years(rows, str(tmp_path / "y"))
    assert readers.read_graph_years(spark, str(tmp_path / "y"), [1, 5]).count() == 40
    writers.write_csv(rows.select("source"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["source"]
    writers.write_json(rows, str(tmp_path / "j"))
    writers.log_metrics(spark, str(tmp_path / "log"), {"a": 1.0}, 1)
    writers.log_metrics(spark, str(tmp_path / "log"), {"a": 2.0}, 2)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert list(writers.micro_batches(iter(range(5)), 2)) == [[0, 1], [2, 3], [4]]
    with pytest.raises(ValueError):
        list(writers.micro_batches(iter([]), 0))


def test_streams(spark, tmp_path):
    path, table = str(tmp_path / "in"), str(tmp_path / "edges")
    one = spark.createDataFrame([(1, "a", "b", 10.0), (2, "a", "b", 10.0)], "year int, source string, target string, value double")
    one.write.parquet(path)
    seen = []
    stream.relabel(stream.stream_edges(spark, path), table, lambda rows, years: seen.append((years, rows.collect())), str(tmp_path / "c1")).awaitTermination()
    spark.createDataFrame([(3, "a", "b", 5.0)], one.schema).write.mode("append").parquet(path)
    stream.relabel(stream.stream_edges(spark, path), table, lambda rows, years: seen.append((years, rows.collect())), str(tmp_path / "c1")).awaitTermination()
    assert [y for y, _ in seen] == [[0, 1, 2, 3], [2, 3, 4]] and [r.y_drop for r in seen[1][1] if r.year == 2] == [1]
    q = stream.running_strengths(stream.stream_edges(spark, path)).writeStream.format("memory").queryName("strengths").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.year, r.node): (r.in_strength, r.out_strength) for r in spark.table("strengths").collect()}[3, "b"] == (5.0, 0.0)
