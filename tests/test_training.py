"""Training of the graph network against finite differences, resuming, fits under losses, and shocks by difference."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import counterfactual, features, gnn, reweighted, training, traversal


@pytest.fixture(scope="module")
def graph(spark):
    """Six nodes in two years: nodes(year, node, features), edges with features, targets and values."""
    rng = random.Random(1)
    names = [f"N{i}_S" for i in range(6)]
    nodes = [(y, n, [rng.random() for _ in range(2)]) for y in (1, 2) for n in names]
    pairs = [(a, b) for a in names for b in names if a != b and rng.random() < 0.5 and a != "N5_S"]
    edges = [(y, a, b, [rng.random()], rng.uniform(-1, 1), rng.uniform(1, 9), rng.uniform(1, 9), float(rng.random() < 0.2)) for y in (1, 2) for a, b in pairs]
    n = spark.createDataFrame(nodes, "year int, node string, features array<double>").cache()
    e = spark.createDataFrame(edges, "year int, source string, target string, features array<double>, target_delta double, value_t double, value_t1 double, mark double").cache()
    return n, e


def with_x(nodes):
    return nodes.select("year", "node", F.concat("features", gnn.numbers([0.0, 0.0])).alias("x"))


def numbers(rows):
    return {r[0]: np.array(r[1:], float) for r in rows}


class Plain:
    """The whole network in numpy on collected rows."""

    def __init__(self, nodes, edges):
        self.nodes = {(r.year, r.node): np.array([*r.features, 0.0, 0.0]) for r in nodes.collect()}
        self.edges = edges.collect()

    def loss(self, net, name, **params):
        norm = lambda x, g, b: (x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).mean() + 1e-5) * np.array(g) + np.array(b)
        w, b, g, s = net.encoder
        state = {k: np.maximum(norm(np.array(w) @ x + b, g, s), 0) for k, x in self.nodes.items()}
        for i, layer in enumerate(net.layers):
            fed = {k: [state[e.year, e.source] for e in self.edges if (e.year, e.target) == k] for k in state}
            out = {}
            for k, x in state.items():
                z = np.array(layer.own) @ x + np.array(layer.fed) @ (np.mean(fed[k], axis=0) if fed[k] else np.zeros_like(x)) + layer.bias
                m, v, g, s = map(np.array, layer.norm)
                z = (z - m) / np.sqrt(v + 1e-5) * g + s
                out[k] = z if i + 1 == len(net.layers) else np.maximum(z, 0)
            state = out
        (w1, b1, g1, s1), (w2, b2), (w3, b3) = net.head
        by_year = {}
        mean = {y: np.mean([np.sqrt(e.value_t + 1) for e in self.edges if e.year == y]) for y in {e.year for e in self.edges}}
        for e in self.edges:
            x = np.concatenate([state[e.year, e.source], state[e.year, e.target], e.features, [e.mark]])
            k = np.maximum(norm(np.array(w1) @ x + b1, g1, s1), 0)
            pred = (np.array(w3) @ (np.array(w2) @ k + b2) + b3)[0] * net.scale + net.shift
            weight = np.clip(np.sqrt(e.value_t + 1) / mean[e.year], 0.1, 10)
            by_year.setdefault(e.year, []).append(training.slope(name, np.array([pred]), np.array([e.target_delta]), weight, **params)[0][0])
        return np.mean([np.mean(v) for v in by_year.values()])


@pytest.mark.parametrize("name, params", [("mse", {}), ("sign_corrected", {"alpha": 0.7}), ("focal", {}), ("focal", {"gamma": 2.0, "boost": 3.0}), ("hybrid", {}), ("weighted_sign", {})])
def test_slopes_of_losses(name, params):
    p, t, w = np.array([0.3, -0.2, 0.4, 1.5]), np.array([0.1, 0.3, -0.6, 1.0]), np.array([0.5, 1.0, 2.0, 3.0])
    up, down = (training.slope(name, p + s, t, w, **params)[0] for s in (1e-6, -1e-6))
    assert training.slope(name, p, t, w, **params)[1] == pytest.approx((up - down) / 2e-6, rel=1e-6)


@pytest.mark.parametrize("loss", ["mse", "weighted_sign"])
def test_gradients_are_finite_differences(graph, loss):
    nodes, edges = graph
    net = training.started(4, 1, hidden=4, seed=3).net
    plain, w = Plain(nodes, edges), training.flat(training.parameters(net))
    value, g = training.gradient(with_x(nodes), edges, edges, net, loss)
    assert value == pytest.approx(plain.loss(net, loss), rel=1e-9)
    for i in range(0, len(w), 1 if loss == "mse" else 7):
        step = np.zeros_like(w)
        step[i] = 1e-6
        want = (plain.loss(training.with_parameters(net, w + step), loss) - plain.loss(training.with_parameters(net, w - step), loss)) / 2e-6
        assert g[i] == pytest.approx(want, abs=2e-6), i


def test_training_goes_down_and_on(graph, spark, tmp_path):
    nodes, edges = graph
    start = lambda: training.started(4, 1, hidden=4, seed=3, rate=0.02)
    run = lambda state, epochs, path: training.train(with_x(nodes), edges, edges, edges, state, epochs, years_a_step=1, metric="rmse", path=path)
    whole = run(start(), 3, str(tmp_path / "a"))
    assert whole.history[-1]["loss"] < whole.history[0]["loss"] and whole.adam.steps == 6
    run(start(), 1, str(tmp_path / "b"))
    again = run(training.load(spark, str(tmp_path / "b"), start().net), 3, str(tmp_path / "b"))
    assert np.allclose(training.flat(training.parameters(again.net)), training.flat(training.parameters(whole.net)), rtol=0, atol=1e-9)
    assert (again.best_epoch, again.idle, again.adam.steps) == (whole.best_epoch, whole.idle, whole.adam.steps) and len(again.history) == 3
    first = training.load(spark, str(tmp_path / "b"), start().net, epoch=1)
    assert first.epoch == 1 and spark.read.parquet(str(tmp_path / "b")).count() == 3
    with pytest.raises(ValueError):
        training.load(spark, str(tmp_path / "b"), start().net, epoch=9)


def test_training_stops_without_gain(graph, monkeypatch):
    nodes, edges = graph
    monkeypatch.setattr(training, "evaluated", lambda *a: {"r2": 0.5})
    monkeypatch.setattr(training, "gradient", lambda *a, **k: (1.0, np.zeros(len(training.flat(training.parameters(training.started(4, 1, hidden=4).net))))))
    out = training.train(with_x(nodes), edges, edges, edges, training.started(4, 1, hidden=4, rate=1.0), 50, patience=8, flat_for=2, refresh=False)
    assert (out.epoch, out.best_epoch) == (9, 1) and out.adam.rate == 0.25


def test_adam_by_hand():
    adam = training.Adam(0.1, 0.0)
    w = adam.step(np.array([1.0, 2.0]), np.array([3.0, -4.0]))  # clipped to length 1
    assert w == pytest.approx([0.9, 2.1], abs=1e-6) and adam.m == pytest.approx([0.06, -0.08], abs=1e-6)


def test_refreshed_norms_are_those_of_the_values(graph):
    nodes, edges = graph
    net = training.refreshed(with_x(nodes), edges, training.started(4, 1, hidden=4, seed=5).net)
    z = np.array([r.z for r in gnn.stored(nodes, edges, net)[2].collect()])
    assert np.allclose(net.layers[1].norm[0], z.mean(axis=0)) and np.allclose(net.layers[1].norm[1], z.var(axis=0))


@pytest.mark.parametrize("loss, params", [("sign_corrected", {"alpha": 2.0}), ("focal", {}), ("focal", {"gamma": 2.0}), ("hybrid", {})])
def test_fits_under_losses(spark, loss, params):
    rng = random.Random(8)
    rows = [(a, b, 0.1 + 0.4 * a - 0.3 * b + rng.choice((0.05, 1.0)) * rng.gauss(0, 1) + (3.0 if rng.random() < 0.05 else 0.0)) for a, b in ((rng.gauss(0, 1), rng.random()) for _ in range(400))]
    df = spark.createDataFrame([*rows, (1.0, None, 0.2), (2.0, 1.0, None)], "a double, b double, t double").cache()
    squares = reweighted.Reweighted(["a", "b"], loss, **params).fit(df, "t", rounds=0)
    model = reweighted.Reweighted(["a", "b"], loss, **params).fit(df, "t")
    assert model.history[-1] < squares.history[0] and model.history == sorted(model.history, reverse=True)
    x = np.array([[1, a, b] for a, b, _ in rows] + [[1, 1.0, 0.0]])
    t = np.array([r[2] for r in rows] + [0.2])
    assert squares.coefficients == pytest.approx(np.linalg.lstsq(x, t, rcond=None)[0].tolist())
    assert model.predict(df).where("a = 1.0").first().pred == pytest.approx(model.coefficients[0] + model.coefficients[1])
    with pytest.raises(ValueError):
        reweighted.Reweighted(["a"], loss).fit(df.limit(0), "t")


def test_shocks_by_difference_are_full_passes(graph, spark):
    nodes, edges = graph
    net = training.started(4, 1, hidden=4, seed=7).net
    edges = edges.select("year", "source", "target", "features")
    trials = [["N0_S"], ["N1_S", "N2_S"], ["N5_S"]]
    shocks = spark.createDataFrame([(k, n) for k, t in enumerate(trials, 1) for n in t], "trial int, node string")
    got = {(r.trial, r.year, r.source, r.target): r.effect for r in gnn.effects(nodes, edges, net, shocks).collect()}
    base = {(r.year, r.source, r.target): r.pred for r in gnn.forward(nodes, edges, net).collect()}
    for k, names in enumerate(trials, 1):
        for r in gnn.forward(nodes, edges, net, counterfactual.valid_shocks(nodes.select(F.col("node").alias("id")), names)).collect():
            want = r.pred - base[r.year, r.source, r.target]
            assert got.get((k, r.year, r.source, r.target), 0.0) == pytest.approx(want, abs=1e-9)
    # A node that supplies nobody changes itself alone, and only its own edges are worked on.
    states = gnn.changed_states(gnn.stored(nodes, edges, net), edges, net, shocks)
    assert [s.where("trial = 3").select("node").distinct().count() for s in states] == [1, 1, 1]
    assert {b for (k, _, _, b) in got if k == 3} == {"N5_S"}
    decay = gnn.decay(nodes, edges, net, trials).collect()
    assert sum(r.n_edges for r in decay) == 3 * edges.count()
    with pytest.raises(ValueError):
        gnn.decay(nodes, edges, net, [["N0_S"], ["nowhere"]])


def test_distances_of_many_trials(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(30)]
    edges = list({(y, rng.choice(names), rng.choice(names)) for y in (1, 2) for _ in range(45)})
    trials = 70  # more than a word
    starts = [(y, t, rng.choice(names)) for y in (1, 2) for t in range(trials) for _ in range(2)]
    e, s = spark.createDataFrame(edges, "year int, source string, target string"), spark.createDataFrame(starts, "year int, trial int, node string")
    got = {(r.year, r.trial, r.source, r.target): r.distance for r in traversal.trial_distances(e, s, trials, 3, ("year",)).collect()}
    plain = {(r.year, r.trial, r.source, r.target): r.distance for r in traversal.edge_distance(e.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))), s, 3, ("year", "trial")).collect()}
    assert got == plain and len(got) == trials * len(edges)
    frontier = traversal.reach(e, s, 2, ("year",))
    assert frontier.count() <= 2 * 2 * len(names)  # a row for each word and node, whatever the number of trials


def test_index_without_one_task(spark):
    names = spark.createDataFrame([(f"k{i % 500:04d}",) for i in range(1500)], "n string")
    rows = features.node_index(names, 7)
    assert [(r.node, r.idx) for r in rows.orderBy("idx").collect()] == [(f"k{i:04d}", i) for i in range(500)]
    assert "SinglePartition" not in rows._jdf.queryExecution().toString() and features.node_index(names.limit(0)).count() == 0
