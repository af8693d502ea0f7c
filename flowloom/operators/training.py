"""Training of the graph network: gradients by joins, Adam with clipping, early stopping, and checkpoints to resume from.

The forward pass keeps each layer's inputs by (year, node). Going back, an edge's head sends its gradient to both ends;
a layer sends a node's gradient to the node's own state and, divided by the number of its suppliers, along the edges in
the other direction. Dense algebra is done in Arrow batches; all that crosses nodes is a join and a summed aggregate.
Gradients of weights are summed up in each task and then by Spark, cut into pieces as long as a state, under keys
without a year; the driver holds weights only.

Norm statistics of the layers are those stored in the network (as in gnn.forward); refreshed() takes them anew from the
states. There is no dropout. Layers are of mean aggregation.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import gnn
from flowloom.operators.metrics import direction_metrics, regression_metrics
from flowloom.operators.predictor import larger_is_better
from flowloom.shared import written

SUMS = "year int, node string, d array<double>"
VALUE = "loss"


def parameters(net: gnn.Network) -> dict[str, np.ndarray]:
    """The weights that are learnt, by name, in a fixed order."""
    out = {f"encoder.{i}": np.array(v, float) for i, v in enumerate(net.encoder)}
    for k, layer in enumerate(net.layers):
        if not isinstance(layer, gnn.Mean):
            raise ValueError("only layers of mean aggregation are trained")
        out |= {f"layer{k}.{n}": np.array(v, float) for n, v in (("own", layer.own), ("fed", layer.fed), ("bias", layer.bias), ("weight", layer.norm[2]), ("shift", layer.norm[3]))}
    return out | {f"head{j}.{i}": np.array(v, float) for j, part in enumerate(net.head) for i, v in enumerate(part)}


def flat(values: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in values.values()])


def with_parameters(net: gnn.Network, values: np.ndarray) -> gnn.Network:
    """The network with its weights taken from flat()."""
    out, at, p = copy.deepcopy(net), 0, {}
    for name, v in parameters(net).items():
        p[name] = values[at : at + v.size].reshape(v.shape).tolist()
        at += v.size
    out.encoder = tuple(p[f"encoder.{i}"] for i in range(4))
    for k, layer in enumerate(out.layers):
        layer.own, layer.fed, layer.bias = (p[f"layer{k}.{n}"] for n in ("own", "fed", "bias"))
        layer.norm = (layer.norm[0], layer.norm[1], p[f"layer{k}.weight"], p[f"layer{k}.shift"])
    out.head = tuple(tuple(p[f"head{j}.{i}"] for i in range(len(part))) for j, part in enumerate(net.head))
    return out


def matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    column = b.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(x: np.ndarray) -> pa.Array:
    return pa.array(list(x), pa.list_(pa.float64()))


def layer_norm(x: np.ndarray, weight, bias) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scaled values, the deviation and what comes out."""
    c = x - x.mean(axis=1, keepdims=True)
    dev = np.sqrt((c * c).mean(axis=1, keepdims=True) + gnn.EPS)
    return c / dev, dev, c / dev * weight + bias


def layer_norm_back(d: np.ndarray, scaled: np.ndarray, dev: np.ndarray, weight) -> np.ndarray:
    d = d * weight
    return (d - d.mean(axis=1, keepdims=True) - scaled * (d * scaled).mean(axis=1, keepdims=True)) / dev


def slope(name: str, p: np.ndarray, t: np.ndarray, weight: np.ndarray, alpha: float = 1.0, gamma: float | None = None, boost: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's loss and its derivative by p; the sign's step has none. Losses as in losses.py."""
    e, wrong = p - t, (np.sign(p) != np.sign(t)).astype(float)
    if name == "mse":
        return e * e, 2 * e
    if name in ("sign_corrected", "weighted_sign"):
        w = np.exp(alpha * wrong) * (weight if name == "weighted_sign" else 1.0)
        return e * e * w, 2 * e * w
    if name == "focal":
        g, w = (1.0 if gamma is None else gamma), 1 + wrong * (boost - 1)
        return np.abs(e) ** (1 + g) * w, (1 + g) * np.abs(e) ** g * np.sign(e) * w
    if name == "hybrid":
        g, w, q = (1.5 if gamma is None else gamma), np.exp(alpha * wrong), e * e + 1e-8
        return e * e * q ** ((g - 1) / 2) * w, (2 * e * q ** ((g - 1) / 2) + e * e * (g - 1) * e * q ** ((g - 3) / 2)) * w
    raise ValueError(f"no loss {name!r}")


class Sums:
    """Gradients of named weights, summed up in a task and given out as rows of pieces as long as a state."""

    def __init__(self, net: gnn.Network) -> None:
        self.values, self.width = {}, len(net.encoder[1])
        self.shapes = {n: v.shape for n, v in parameters(net).items()}

    def add(self, **values: np.ndarray) -> None:
        for n, v in values.items():
            name = n.replace("__", ".")
            self.values[name] = self.values.get(name, 0.0) + v

    def rows(self) -> pa.RecordBatch:
        keys, pieces = [], []
        for name, v in self.values.items():
            v = np.atleast_1d(np.asarray(v, float)).ravel()
            v = np.concatenate([v, np.zeros(-len(v) % self.width)]).reshape(-1, self.width)
            keys += [f"{name}|{i}" for i in range(len(v))]
            pieces += list(v)
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array(pieces, pa.list_(pa.float64()))], ["year", "node", "d"])


def summed(rows: DataFrame, width: int) -> DataFrame:
    return rows.groupBy("year", "node").agg(F.array(*[F.sum(F.col("d")[i]) for i in range(width)]).alias("d"))


def states(nodes: DataFrame, edges: DataFrame, net: gnn.Network) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """The encoder's states, each layer's table (year, node, own, fed, n: suppliers, state) and the last states; nodes: year, node, x (features and marks)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, weight, bias = (np.array(v, float) for v in net.encoder)
        for batch in batches:
            out = layer_norm(matrix(batch, "x") @ w.T + b, weight, bias)[2]
            yield pa.RecordBatch.from_arrays([batch.column("year"), batch.column("node"), lists(np.maximum(out, 0))], ["year", "node", "state"])

    def layer_run(layer: gnn.Mean, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, fed, bias = (np.array(v, float) for v in (layer.own, layer.fed, layer.bias))
            mean, var, weight, shift = (np.array(v, float) for v in layer.norm)
            for batch in batches:
                z = matrix(batch, "own") @ own.T + matrix(batch, "fed") @ fed.T + bias
                out = (z - mean) / np.sqrt(var + gnn.EPS) * weight + shift
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(out if last else np.maximum(out, 0))], [*batch.schema.names, "state"])

        return run

    h, links = len(net.encoder[1]), edges.select("year", "target", F.col("source").alias("node"))
    state = first = written(nodes.select("year", "node", "x").mapInArrow(encode, "year int, node string, state array<double>"), "state")
    tables = []
    for k, layer in enumerate(net.layers):
        fed = links.join(state, ["year", "node"]).groupBy("year", F.col("target").alias("node")).agg(F.array(*[F.avg(F.col("state")[i]) for i in range(h)]).alias("fed"), F.count(F.lit(1)).alias("n"))
        both = state.withColumnRenamed("state", "own").join(fed, ["year", "node"], "left").select("year", "node", "own", F.coalesce("fed", gnn.numbers([0.0] * h)).alias("fed"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        tables.append(written(both.mapInArrow(layer_run(layer, k + 1 == len(net.layers)), "year int, node string, own array<double>, fed array<double>, n bigint, state array<double>"), "layer"))
        state = tables[-1].select("year", "node", "state")
    return first, tables, state


def gradient(nodes: DataFrame, edges: DataFrame, rows: DataFrame, net: gnn.Network, loss: str = "mse", **params: float) -> tuple[float, np.ndarray]:
    """The loss and its gradient by flat() of the weights: the mean over years of each year's mean over rows.

    nodes: year, node, x. edges: year, source, target, all that states pass along. rows: year, source, target, features,
    target_delta, of the years to learn from; with value_t for weighted_sign, with mark 1 for a shocked edge.
    """
    h = len(net.encoder[1])
    years = {r.year: (r.n, r.w) for r in rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.sqrt(F.col("value_t") + 1)) if loss == "weighted_sign" else F.lit(1.0)).alias("w")).collect()}
    if not years:
        raise ValueError("no rows to learn from")
    first, tables, last = states(nodes, edges, net)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums(net)
        (w1, b1, g1, s1), (w2, b2), (w3, b3) = [[np.array(v, float) for v in part] for part in net.head]
        for b in batches:
            x = np.column_stack([matrix(b, "s"), matrix(b, "t"), matrix(b, "features"), b.column("mark").to_numpy()])
            scaled, dev, normed = layer_norm(x @ w1.T + b1, g1, s1)
            k = np.maximum(normed, 0)
            y = k @ w2.T + b2
            pred = (y @ w3.T + b3)[:, 0] * net.scale + net.shift
            year = b.column("year").to_pylist()
            n, mean = (np.array([years[v][i] for v in year], float) for i in (0, 1))
            weight = np.clip(np.sqrt(b.column("value").to_numpy() + 1) / mean, 0.1, 10.0)
            value, d = slope(loss, pred, b.column("target_delta").to_numpy(), weight, **params)
            d = (d / (n * len(years)) * net.scale)[:, None]
            dy = d @ w3
            dk = (dy @ w2) * (normed > 0)
            dh = layer_norm_back(dk, scaled, dev, g1)
            dx = dh @ w1
            total.add(loss=(value / (n * len(years))).sum(), head2__0=d.T @ y, head2__1=d.sum(axis=0), head1__0=dy.T @ k, head1__1=dy.sum(axis=0), head0__0=dh.T @ x, head0__1=dh.sum(axis=0), head0__2=(dk * scaled).sum(axis=0), head0__3=dk.sum(axis=0))
            for end, at in (("source", 0), ("target", h)):
                yield pa.RecordBatch.from_arrays([b.column("year"), b.column(end), lists(dx[:, at : at + h])], ["year", "node", "d"])
        yield total.rows()

    side = lambda end, name: last.select("year", F.col("node").alias(end), F.col("state").alias(name))
    value = F.col("value_t") if loss == "weighted_sign" else F.lit(1.0)
    mark = F.coalesce(F.col("mark").cast("double"), F.lit(0.0)) if "mark" in rows.columns else F.lit(0.0)
    ends = rows.select("year", "source", "target", "features", F.col("target_delta").cast("double").alias("target_delta"), value.cast("double").alias("value"), mark.alias("mark"))
    ends = ends.join(side("source", "s"), ["year", "source"]).join(side("target", "t"), ["year", "target"])
    sums = [written(summed(ends.mapInArrow(head, SUMS), h), "back")]

    for k in range(len(net.layers) - 1, -1, -1):
        layer, is_last = net.layers[k], k + 1 == len(net.layers)

        def down(batches: Iterator[pa.RecordBatch], layer=layer, k=k, is_last=is_last) -> Iterator[pa.RecordBatch]:
            total = Sums(net)
            own, fed, bias = (np.array(v, float) for v in (layer.own, layer.fed, layer.bias))
            mean, var, weight, shift = (np.array(v, float) for v in layer.norm)
            for b in batches:
                x, f, n = matrix(b, "own"), matrix(b, "fed"), b.column("n").to_numpy()
                scaled = (x @ own.T + f @ fed.T + bias - mean) / np.sqrt(var + gnn.EPS)
                d = matrix(b, "d") * (1.0 if is_last else (scaled * weight + shift > 0))
                z = d * weight / np.sqrt(var + gnn.EPS)
                total.add(**{f"layer{k}__own": z.T @ x, f"layer{k}__fed": z.T @ f, f"layer{k}__bias": z.sum(axis=0), f"layer{k}__weight": (d * scaled).sum(axis=0), f"layer{k}__shift": d.sum(axis=0)})
                yield pa.RecordBatch.from_arrays([b.column("year"), b.column("node"), lists(z @ own), lists(z @ fed / np.maximum(n, 1)[:, None])], ["year", "node", "d", "f"])
            rest = total.rows()
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.nulls(rest.num_rows, pa.list_(pa.float64()))], ["year", "node", "d", "f"])

        both = tables[k].select("year", "node", "own", "fed", "n").join(sums[-1].where("year IS NOT NULL"), ["year", "node"])
        back = written(both.mapInArrow(down, SUMS + ", f array<double>"), "down")
        along = edges.select("year", "source", F.col("target").alias("node")).join(back.where("year IS NOT NULL").select("year", "node", "f"), ["year", "node"]).select("year", F.col("source").alias("node"), F.col("f").alias("d"))
        sums.append(written(summed(back.select("year", "node", "d").unionByName(along), h), "back"))

    def encoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums(net)
        w, b0, weight, bias = (np.array(v, float) for v in net.encoder)
        for b in batches:
            x = matrix(b, "x")
            scaled, dev, normed = layer_norm(x @ w.T + b0, weight, bias)
            d = matrix(b, "d") * (normed > 0)
            z = layer_norm_back(d, scaled, dev, weight)
            total.add(encoder__0=z.T @ x, encoder__1=z.sum(axis=0), encoder__2=(d * scaled).sum(axis=0), encoder__3=d.sum(axis=0))
        yield total.rows()

    sums.append(summed(nodes.select("year", "node", "x").join(sums[-1].where("year IS NOT NULL"), ["year", "node"]).mapInArrow(encoder, SUMS), h))
    pieces: dict[str, dict[int, list[float]]] = {}
    for table in sums:
        for r in table.where("year IS NULL").collect():
            name, _, i = r.node.rpartition("|")
            pieces.setdefault(name, {})[int(i)] = r.d
    out = []
    for name, v in parameters(net).items():
        held = pieces.get(name, {})
        out.append(np.concatenate([held[i] for i in sorted(held)])[: v.size] if held else np.zeros(v.size))
    return pieces[VALUE][0][0], np.concatenate(out)


def refreshed(nodes: DataFrame, edges: DataFrame, net: gnn.Network) -> gnn.Network:
    """The network with each layer's norm statistics taken from the nodes' values before the norm, layer by layer."""
    out, h = copy.deepcopy(net), len(net.encoder[1])
    for k in range(len(out.layers)):
        shorter = copy.deepcopy(out)
        shorter.layers = shorter.layers[: k + 1]
        layer = shorter.layers[k]
        # A norm that leaves the values as they are, in the last place: no relu follows.
        layer.norm = ([0.0] * h, [1.0 - gnn.EPS] * h, [1.0] * h, [0.0] * h)
        z = states(nodes, edges, shorter)[2]
        one = z.agg(*[f(F.col("state")[i]).alias(f"{n}{i}") for i in range(h) for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
        _, _, weight, shift = out.layers[k].norm
        out.layers[k].norm = ([one[f"m{i}"] or 0.0 for i in range(h)], [one[f"v{i}"] or 0.0 for i in range(h)], weight, shift)
    return out


@dataclass
class Adam:
    """Moments and steps so far; a step clips the gradient's norm and adds the decay."""

    rate: float = 0.002
    decay: float = 1e-4
    clip: float = 1.0
    steps: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None

    def step(self, weights: np.ndarray, g: np.ndarray, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> np.ndarray:
        g = g * min(1.0, self.clip / (np.sqrt((g * g).sum()) + 1e-6)) + self.decay * weights
        self.m, self.v = (np.zeros_like(g), np.zeros_like(g)) if self.m is None else (self.m, self.v)
        self.steps += 1
        self.m, self.v = b1 * self.m + (1 - b1) * g, b2 * self.v + (1 - b2) * g * g
        return weights - self.rate * (self.m / (1 - b1**self.steps)) / (np.sqrt(self.v / (1 - b2**self.steps)) + eps)


@dataclass
class State:
    """All that training needs to go on: after `epoch` epochs, with the best so far, epochs without a better one (idle) and since the rate last fell (waited)."""

    net: gnn.Network
    adam: Adam
    epoch: int = 0
    best: gnn.Network | None = None
    best_value: float = float("-inf")
    best_epoch: int = 0
    idle: int = 0
    waited: int = 0
    history: list[dict] = field(default_factory=list)


def save(state: State, spark: SparkSession, path: str) -> None:
    """One row more in the table at path. Spark moves the finished file into place, so a version is there as a whole or not at all, and earlier ones stay."""
    norms = lambda net: json.dumps([layer.norm[:2] for layer in net.layers])
    best, a = state.best or state.net, state.adam
    row = (
        state.epoch, flat(parameters(state.net)).tolist(), norms(state.net), flat(parameters(best)).tolist(), norms(best), state.best_value, state.best_epoch, state.idle, state.waited,
        a.rate, a.decay, a.clip, a.steps, a.m.tolist() if a.m is not None else None, a.v.tolist() if a.v is not None else None, json.dumps(state.history),
    )
    schema = "epoch int, weights array<double>, norms string, best array<double>, best_norms string, best_value double, best_epoch int, idle int, waited int, rate double, decay double, clip double, steps int, m array<double>, v array<double>, history string"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, like: gnn.Network, epoch: int | None = None) -> State:
    """The last version at path, or that of an epoch. like: a network of the same form."""
    rows = spark.read.parquet(path)
    r = (rows.where(F.col("epoch") == epoch) if epoch is not None else rows.orderBy(F.desc("epoch")).limit(1)).first()
    if r is None:
        raise ValueError("no such checkpoint")

    def network(weights: list[float], norms: str) -> gnn.Network:
        net = with_parameters(like, np.array(weights))
        for layer, held in zip(net.layers, json.loads(norms), strict=True):
            layer.norm = (held[0], held[1], *layer.norm[2:])
        return net

    adam = Adam(r.rate, r.decay, r.clip, r.steps, *(np.array(x) if x is not None else None for x in (r.m, r.v)))
    return State(network(r.weights, r.norms), adam, r.epoch, network(r.best, r.best_norms), r.best_value, r.best_epoch, r.idle, r.waited, json.loads(r.history))


def evaluated(nodes: DataFrame, edges: DataFrame, rows: DataFrame, net: gnn.Network) -> dict[str, float]:
    """Means over years of the metrics of rows (with value_t and value_t1), predicted by the network; node features hold the marks."""
    last = states(nodes, edges, net)[2]
    (w1, b1, g1, s1), (w2, b2), (w3, b3) = [[np.array(v, float) for v in part] for part in net.head]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([matrix(b, "s"), matrix(b, "t"), matrix(b, "features"), b.column("mark").to_numpy()])
            k = np.maximum(layer_norm(x @ w1.T + b1, g1, s1)[2], 0)
            pred = ((k @ w2.T + b2) @ w3.T + b3)[:, 0] * net.scale + net.shift
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("year", "target_delta", "value_t", "value_t1")), pa.array(pred)], ["year", "target_delta", "value_t", "value_t1", "pred"])

    side = lambda end, name: last.select("year", F.col("node").alias(end), F.col("state").alias(name))
    mark = F.coalesce(F.col("mark").cast("double"), F.lit(0.0)) if "mark" in rows.columns else F.lit(0.0)
    ends = rows.select("year", "source", "target", "features", *[F.col(c).cast("double").alias(c) for c in ("target_delta", "value_t", "value_t1")], mark.alias("mark"))
    ends = ends.join(side("source", "s"), ["year", "source"]).join(side("target", "t"), ["year", "target"])
    pred = written(ends.mapInArrow(run, "year int, target_delta double, value_t double, value_t1 double, pred double"), "predicted")
    both = regression_metrics(pred).join(direction_metrics(pred), "year")
    names = [c for c in both.columns if c != "year"]
    return {k: v for k, v in both.agg(*[F.avg(c).alias(c) for c in names]).first().asDict().items() if v is not None}


def train(nodes: DataFrame, edges: DataFrame, rows: DataFrame, check: DataFrame, state: State, epochs: int = 20, years_a_step: int = 4, loss: str = "mse", metric: str = "r2", patience: int = 15, flat_for: int = 5, factor: float = 0.5, path: str | None = None, refresh: bool = True, **params: float) -> State:
    """Goes on from state until `epochs` epochs are done or `patience` have brought nothing better in `metric` on the rows of check.

    A step learns from years_a_step years at once, in their order. After more than flat_for epochs without a better
    value the rate falls by factor. With path each epoch is saved there; load() and train() again give the same as no stop.
    """
    years = sorted(r.year for r in rows.select("year").distinct().collect())
    sign = 1.0 if larger_is_better(metric) else -1.0
    while state.epoch < epochs and state.idle < patience:
        if refresh:
            state.net = refreshed(nodes, edges, state.net)
        total = 0.0
        for at in range(0, len(years), years_a_step):
            some = years[at : at + years_a_step]
            within = [t.where(F.col("year").isin(some)) for t in (nodes, edges, rows)]
            value, g = gradient(*within, state.net, loss, **params)
            total += value * len(some)
            state.net = with_parameters(state.net, state.adam.step(flat(parameters(state.net)), g))
        found = evaluated(nodes, edges, check, state.net)
        state.epoch += 1
        state.history.append({"epoch": state.epoch, "rate": state.adam.rate, "loss": total / len(years)} | found)
        if sign * found.get(metric, float("nan")) > state.best_value:
            state.best, state.best_value, state.best_epoch, state.idle, state.waited = copy.deepcopy(state.net), sign * found[metric], state.epoch, 0, 0
        else:
            state.idle, state.waited = state.idle + 1, state.waited + 1
            if state.waited > flat_for:
                state.adam.rate, state.waited = state.adam.rate * factor, 0
        if path:
            save(state, nodes.sparkSession, path)
    return state


def started(features: int, edge_features: int, hidden: int = 64, layers: int = 2, seed: int = 0, scale: float = 4.0, **adam: float) -> State:
    """A network of small random weights, and nothing learnt. features: of a node, marks included."""
    rng = np.random.default_rng(seed)
    draw = lambda n, m: (rng.uniform(-1, 1, (n, m)) / np.sqrt(m)).tolist()
    ones, zeros = [1.0] * hidden, [0.0] * hidden
    mean = lambda: gnn.Mean(draw(hidden, hidden), draw(hidden, hidden), list(zeros), (list(zeros), list(ones), list(ones), list(zeros)))
    half = max(1, hidden // 2)
    head = ((draw(hidden, 2 * hidden + edge_features + 1), list(zeros), list(ones), list(zeros)), (draw(half, hidden), [0.0] * half), (draw(1, half), [0.0]))
    return State(gnn.Network((draw(hidden, features), list(zeros), list(ones), list(zeros)), [mean() for _ in range(layers)], head, scale, 0.0), Adam(**adam))
