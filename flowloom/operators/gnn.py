"""The graph network's forward pass with given weights, as joins, aggregations and array expressions.

Node features and two marks (shocked; supplied by a shocked node) go through an encoder (linear, layer norm, relu), then
layers of mean aggregation or of attention, each with a batch norm of stored statistics and, but for the last, a relu;
an edge's head (linear, layer norm, relu, linear, linear) sees both ends, the edge's features and a mark for a shocked
edge; its value is scaled and shifted. A node's state is one array; sums over its suppliers are one aggregate for each
element, so no neighbourhood is gathered. Each layer's states are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators import counterfactual
from flowloom.operators.traversal import trial_distances
from flowloom.shared import written

Matrix = list[list[float]]
EPS = 1e-5


@dataclass
class Mean:
    """own and fed: weights of a node's own state and of its suppliers' mean; norm: mean, variance, weight and bias of the batch norm."""

    own: Matrix
    fed: Matrix
    bias: list[float]
    norm: tuple[list[float], list[float], list[float], list[float]]


@dataclass
class Attention:
    """One matrix, and weights of the sending and of the receiving side, for each head; heads are averaged."""

    heads: list[tuple[Matrix, list[float], list[float]]]
    bias: list[float]
    norm: tuple[list[float], list[float], list[float], list[float]]
    slope: float = 0.2


@dataclass
class Network:
    """encoder: weights, bias, norm's weight and bias. head: the same, then two more layers. scale and shift of what comes out."""

    encoder: tuple[Matrix, list[float], list[float], list[float]]
    layers: list[Mean | Attention]
    head: tuple[tuple[Matrix, list[float], list[float], list[float]], tuple[Matrix, list[float]], tuple[Matrix, list[float]]]
    scale: float = 4.0
    shift: float = 0.0


def numbers(values: list[float]) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def linear(x: Column, weights: Matrix, bias: list[float]) -> Column:
    """A dense layer of an array column: one dot product for each output."""
    return F.array(*[F.aggregate(F.zip_with(x, numbers(row), lambda a, b: a * b), F.lit(float(c)), lambda s, v: s + v) for row, c in zip(weights, bias, strict=True)])


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def layer_norm(x: Column, weight: list[float], bias: list[float]) -> Column:
    n = len(weight)
    centred = let(total(x) / n, lambda m: F.transform(x, lambda v: v - m))

    def scaled(c: Column) -> Column:
        by = F.sqrt(total(F.transform(c, lambda v: v * v)) / n + EPS)
        return let(by, lambda d: F.transform(c, lambda v, i: v / d * F.get(numbers(weight), i) + F.get(numbers(bias), i)))

    return let(centred, scaled)


def batch_norm(x: Column, norm: tuple[list[float], list[float], list[float], list[float]]) -> Column:
    """With stored statistics: a factor and a shift for each element."""
    factor = [w / (v + EPS) ** 0.5 for v, w in zip(norm[1], norm[2], strict=True)]
    shift = [b - m * f for m, b, f in zip(norm[0], norm[3], factor, strict=True)]
    return F.transform(x, lambda v, i: v * F.get(numbers(factor), i) + F.get(numbers(shift), i))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def mean_layer(state: DataFrame, edges: DataFrame, layer: Mean) -> DataFrame:
    n = len(layer.own[0])
    fed = edges.select("year", "target", F.col("source").alias("node")).join(state, ["year", "node"])
    fed = fed.groupBy("year", F.col("target").alias("node")).agg(F.array(*[F.avg(F.col("state")[i]) for i in range(n)]).alias("fed"))
    both = state.join(fed, ["year", "node"], "left").withColumn("fed", F.coalesce("fed", numbers([0.0] * n)))
    out = linear(F.concat("state", "fed"), [a + b for a, b in zip(layer.own, layer.fed, strict=True)], layer.bias)
    return both.select("year", "node", out.alias("state"))


def attention_layer(state: DataFrame, edges: DataFrame, layer: Attention) -> DataFrame:
    """Each node is one of its own suppliers; shares are the softmax of leaky scores over a node's suppliers."""
    heads, n = range(len(layer.heads)), len(layer.bias)
    sides = state.select("year", "node", *[linear(F.col("state"), w, [0.0] * n).alias(f"z{h}") for h, (w, _, _) in enumerate(layer.heads)])
    score = lambda h, side: total(F.zip_with(F.col(f"z{h}"), numbers(layer.heads[h][side]), lambda a, b: a * b))
    sends = sides.select("year", F.col("node").alias("source"), *[f"z{h}" for h in heads], *[score(h, 1).alias(f"s{h}") for h in heads])
    takes = sides.select("year", F.col("node").alias("target"), *[score(h, 2).alias(f"t{h}") for h in heads])
    pairs = edges.where("source <> target").select("year", "source", "target").unionByName(state.select("year", F.col("node").alias("source"), F.col("node").alias("target")))
    leaky = lambda x: F.when(x > 0, x).otherwise(x * layer.slope)
    # The leaky score rises with the sender's part, so a target's greatest is that of its greatest sender: scores alone go along the edges for it.
    most = pairs.join(sends.select("year", "source", *[f"s{h}" for h in heads]), ["year", "source"]).groupBy("year", "target").agg(*[F.max(f"s{h}").alias(f"m{h}") for h in heads])
    takes = takes.join(most, ["year", "target"]).select("year", "target", *[f"t{h}" for h in heads], *[leaky(F.col(f"m{h}") + F.col(f"t{h}")).alias(f"m{h}") for h in heads])
    rows = pairs.join(sends, ["year", "source"]).join(takes, ["year", "target"]).withColumns({f"w{h}": F.exp(leaky(F.col(f"s{h}") + F.col(f"t{h}")) - F.col(f"m{h}")) for h in heads})
    sums = rows.groupBy("year", F.col("target").alias("node")).agg(*[F.sum(f"w{h}").alias(f"w{h}") for h in heads], *[F.sum(F.col(f"w{h}") * F.col(f"z{h}")[i]).alias(f"v{h}_{i}") for h in heads for i in range(n)])
    out = F.array(*[sum((F.col(f"v{h}_{i}") / F.col(f"w{h}") for h in heads), F.lit(0.0)) / len(heads) + float(layer.bias[i]) for i in range(n)])
    return sums.select("year", "node", out.alias("state"))


def forward(nodes: DataFrame, edges: DataFrame, network: Network, shocked: DataFrame | None = None) -> DataFrame:
    """edges(year, source, target, features) with pred. nodes: year, node, features. shocked: id of the shocked nodes; edges may have shocked, 1 for a shocked edge."""
    hit = shocked.select(F.col("id").alias("node"), F.lit(1.0).alias("hit")).distinct() if shocked is not None else nodes.select("node", F.lit(0.0).alias("hit")).limit(0)
    fed = edges.join(hit.withColumnRenamed("node", "source"), "source").select("year", F.col("target").alias("node"), F.lit(1.0).alias("fed")).distinct()
    marks = F.array(F.coalesce("hit", F.lit(0.0)), F.coalesce("fed", F.lit(0.0)))
    state = nodes.join(hit, "node", "left").join(fed, ["year", "node"], "left").select("year", "node", F.concat("features", marks).alias("x"))
    w, b, gamma, beta = network.encoder
    state = state.select("year", "node", relu(layer_norm(linear(F.col("x"), w, b), gamma, beta)).alias("state"))
    for i, layer in enumerate(network.layers):
        out = (mean_layer if isinstance(layer, Mean) else attention_layer)(state, edges, layer)
        normed = batch_norm(F.col("state"), layer.norm)
        state = written(out.select("year", "node", (normed if i + 1 == len(network.layers) else relu(normed)).alias("state")), "state")
    ends = edges.join(state.select("year", F.col("node").alias("source"), F.col("state").alias("__s")), ["year", "source"]).join(state.select("year", F.col("node").alias("target"), F.col("state").alias("__t")), ["year", "target"])
    mark = F.coalesce(F.col("shocked").cast("double"), F.lit(0.0)) if "shocked" in edges.columns else F.lit(0.0)
    (w, b, gamma, beta), second, third = network.head
    out = linear(linear(relu(layer_norm(linear(F.concat("__s", "__t", "features", F.array(mark)), w, b), gamma, beta)), *second), *third)
    return ends.withColumn("pred", F.get(out, F.lit(0)) * network.scale + network.shift).drop("__s", "__t")


def both_runs(nodes: DataFrame, edges: DataFrame, network: Network, wanted: list[str]) -> DataFrame:
    """edges with baseline_delta and shocked_delta: the network's predictions without a shock and with one of the wanted nodes."""
    valid = counterfactual.valid_shocks(nodes.select(F.col("node").alias("id")), wanted)
    key = ["year", "source", "target"]
    base = forward(nodes, edges, network).withColumnRenamed("pred", "baseline_delta")
    return base.join(forward(nodes, edges, network, valid).select(*key, F.col("pred").alias("shocked_delta")), key)


def simulate(nodes: DataFrame, edges: DataFrame, network: Network, wanted: list[str], magnitude: float = 0.2) -> DataFrame:
    """A counterfactual run end to end: values with and without the shock for each edge (year, source, target, value_t, features)."""
    return counterfactual.simulate_shock(both_runs(nodes, edges, network, wanted), wanted, magnitude)


def stored(nodes: DataFrame, edges: DataFrame, network: Network) -> list[DataFrame]:
    """Of a run without a shock: (year, node, x, state) of the encoder, then (year, node, z, state) of each layer, z before the norm, as written tables. Layers of mean aggregation."""
    w, b, gamma, beta = network.encoder
    out = [written(nodes.select("year", "node", F.concat("features", numbers([0.0, 0.0])).alias("x")).withColumn("state", relu(layer_norm(linear(F.col("x"), w, b), gamma, beta))), "state")]
    for i, layer in enumerate(network.layers):
        if not isinstance(layer, Mean):
            raise ValueError("differences are passed on through layers of mean aggregation only")
        z = mean_layer(out[-1].select("year", "node", "state"), edges, layer).withColumnRenamed("state", "z")
        out.append(written(z.withColumn("state", after(F.col("z"), network, i)), "state"))
    return out


def after(z: Column, network: Network, i: int) -> Column:
    """A layer's state from the value before its norm."""
    normed = batch_norm(z, network.layers[i].norm)
    return normed if i + 1 == len(network.layers) else relu(normed)


def changed_states(base: list[DataFrame], edges: DataFrame, network: Network, shocks: DataFrame) -> list[DataFrame]:
    """trial, year, node and d (the state with the trial's shock less that without), after the encoder and each layer, of the nodes that the shock has reached by then.

    base: what stored() gives. shocks: trial, node. A layer takes on the nodes changed before and those that they supply;
    no other row of any table is worked on, whatever the number of trials.
    """
    h, key = len(network.encoder[1]), ["trial", "year", "node"]
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    hit = shocks.select("trial", "node").distinct().join(base[0].select("year", "node"), "node").select(*key, F.lit(1.0).alias("hit"), F.lit(0.0).alias("fed"))
    fed = shocks.select("trial", F.col("node").alias("source")).distinct().join(edges.select("year", "source", "target"), "source").select("trial", "year", F.col("target").alias("node"), F.lit(0.0).alias("hit"), F.lit(1.0).alias("fed"))
    marks = hit.unionByName(fed).groupBy(*key).agg(F.max("hit").alias("hit"), F.max("fed").alias("fed"))
    w, b, gamma, beta = network.encoder
    own = len(w[0]) - 2
    new = relu(layer_norm(linear(F.concat(F.slice("x", 1, own), F.array("hit", "fed")), w, b), gamma, beta))
    out = [written(marks.join(base[0], ["year", "node"]).select(*key, minus(new, F.col("state")).alias("d")), "changed")]
    count = written(edges.groupBy("year", F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n")), "suppliers")
    for i, layer in enumerate(network.layers):
        along = out[-1].join(edges.select("year", F.col("source").alias("node"), "target"), ["year", "node"]).groupBy("trial", "year", F.col("target").alias("node")).agg(*[F.sum(F.col("d")[k]).alias(f"f{k}") for k in range(h)])
        along = along.join(count, ["year", "node"]).select(*key, F.array(*[F.col(f"f{k}") / F.col("n") for k in range(h)]).alias("f"))
        both = out[-1].join(along, key, "full").select(*key, F.coalesce("d", numbers([0.0] * h)).alias("d"), F.coalesce("f", numbers([0.0] * h)).alias("f"))
        move = linear(F.concat("d", "f"), [x + y for x, y in zip(layer.own, layer.fed, strict=True)], [0.0] * h)
        moved = both.join(base[i + 1], ["year", "node"]).select(*key, minus(after(plus(F.col("z"), move), network, i), F.col("state")).alias("d"))
        out.append(written(moved, "changed"))
    return out


def effects(nodes: DataFrame, edges: DataFrame, network: Network, shocks: DataFrame) -> DataFrame:
    """trial, year, source, target, effect for each edge with an end that the trial's shock reaches; on all others it has none. shocks: trial, node."""
    base = stored(nodes, edges, network)
    return edge_effects(base[-1], changed_states(base, edges, network, shocks)[-1], edges, network)


def edge_effects(last: DataFrame, changed: DataFrame, edges: DataFrame, network: Network) -> DataFrame:
    h = len(network.encoder[1])
    links = edges.select("year", "source", "target")
    reached = [changed.select("trial", "year", F.col("node").alias(end)).join(links, ["year", end]).select("trial", "year", "source", "target") for end in ("source", "target")]
    rows = reached[0].unionByName(reached[1]).distinct().join(edges.select("year", "source", "target", "features", (F.coalesce(F.col("shocked").cast("double"), F.lit(0.0)) if "shocked" in edges.columns else F.lit(0.0)).alias("mark")), ["year", "source", "target"])
    for end in ("source", "target"):
        rows = rows.join(last.select("year", F.col("node").alias(end), F.col("state").alias(f"__{end}")), ["year", end]).join(changed.select("trial", "year", F.col("node").alias(end), F.col("d").alias(f"__d_{end}")), ["trial", "year", end], "left")
    (w, b, gamma, beta), second, third = network.head

    def pred(source: Column, target: Column) -> Column:
        return F.get(linear(linear(relu(layer_norm(linear(F.concat(source, target, "features", F.array("mark")), w, b), gamma, beta)), *second), *third), F.lit(0)) * network.scale

    with_shock = [F.zip_with(F.col(f"__{end}"), F.coalesce(f"__d_{end}", numbers([0.0] * h)), lambda x, y: x + y) for end in ("source", "target")]
    return rows.select("trial", "year", "source", "target", (pred(*with_shock) - pred(F.col("__source"), F.col("__target"))).alias("effect"))


def decay(nodes: DataFrame, edges: DataFrame, network: Network, trials: list[list[str]], cap: int = 3) -> DataFrame:
    """year, trial, distance and what hop_decay() gives: one run without a shock, and what the shocks of all trials change of it, in one plan."""
    wanted = nodes.sparkSession.createDataFrame([(k, n) for k, names in enumerate(trials, 1) for n in names], "trial int, node string")
    shocks = wanted.join(nodes.select("node").distinct(), "node", "left_semi").select("trial", "node")
    if shocks.select("trial").distinct().count() < len(trials):
        raise ValueError("none of the shocked nodes of a trial is in the graph")
    key = ["trial", "year", "source", "target"]
    years = edges.select("year").distinct()
    far = trial_distances(edges.select(*key[1:]), shocks.join(F.broadcast(years)).select("year", (F.col("trial") - 1).alias("trial"), "node"), len(trials), cap, ("year",))
    rows = far.withColumn("trial", (F.col("trial") + 1).cast("int")).join(effects(nodes, edges, network, shocks), key, "left")
    return counterfactual.hop_decay(rows.select("year", "trial", "distance", F.coalesce("effect", F.lit(0.0)).alias("effect")))
