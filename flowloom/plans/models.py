"""Queries on the graph network with given weights, over all years: forward passes, a counterfactual run end to end and its decay, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import features as N
from flowloom.operators import gnn, training
from flowloom.plans.network import NODE, OTHER, YEAR, rounded
from flowloom.plans.sql import EDGES, Queries
from flowloom.shared import written
from flowloom.sources import trade

query = Queries()
TRIALS = ([NODE, OTHER], ["N01_S0", "N04_S4", "N17_S3"])


def weights(rows: int, columns: int, seed: int) -> gnn.Matrix:
    """Small numbers of both signs by a rule."""
    return [[round(((7 * i + 3 * j + 5 * seed) % 11 - 5) / 20, 3) for j in range(columns)] for i in range(rows)]


def network(attention: bool) -> gnn.Network:
    def norm(seed: int) -> tuple[list[float], ...]:
        mean, _, weight = weights(3, 3, seed)
        return mean, [0.5, 1.0, 1.5], [1 + w for w in weight], [0.1, 0.0, -0.1]

    def layer(seed: int) -> gnn.Mean | gnn.Attention:
        if attention:
            return gnn.Attention([(weights(3, 3, seed + h), weights(1, 3, seed + h + 1)[0], weights(1, 3, seed + h + 2)[0]) for h in range(2)], [0.05, -0.05, 0.1], norm(seed))
        return gnn.Mean(weights(3, 3, seed), weights(3, 3, seed + 1), [0.05, -0.05, 0.1], norm(seed))

    head = ((weights(3, 10, 4), [0.1, -0.1, 0.2], [1.0, 0.9, 1.1], [0.0, 0.1, -0.1]), (weights(2, 3, 6), [0.1, 0.2]), (weights(1, 2, 8), [0.05]))
    return gnn.Network((weights(3, 4, 1), [0.1, 0.2, -0.1], [1.0, 1.1, 0.9], [0.05, 0.0, -0.05]), [layer(2), layer(9)], head, 4.0, 0.01)


def inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all years with their features."""
    edges = written(trade.edges(spark, sf_dir), "edges")
    nodes = N.node_strengths(edges).select("year", "node", F.array(F.log1p("in_strength"), F.log1p("out_strength")).alias("features"))
    rows = N.edge_features(edges).select("year", "source", "target", F.col("value").alias("value_t"), F.array("log_value_t", "share_target", "share_source").alias("features"))
    return written(nodes, "nodes"), written(rows, "flows")


def dots(columns: list[str], matrix: gnn.Matrix, bias: list[float]) -> list[str]:
    return [" + ".join([repr(float(c)), *[f"{w!r} * {x}" for x, w in zip(columns, row, strict=True)]]) for row, c in zip(matrix, bias, strict=True)]


def named(values: list[str], name: str) -> str:
    return ", ".join(f"{v} AS {name}{i}" for i, v in enumerate(values))


def normed(source: str, keys: str, name: str, weight: list[float], bias: list[float], out: str) -> str:
    """Layer norm and relu of columns name0, name1, ... of a table."""
    cols = [f"{name}{i}" for i in range(len(weight))]
    mean = f"(({' + '.join(cols)}) / {len(cols)})"
    dev = f"sqrt(({' + '.join(f'power({c} - {mean}, 2)' for c in cols)}) / {len(cols)} + 1e-5)"
    return f"SELECT {keys}, {named([f'greatest(0, ({c} - {mean}) / {dev} * {w!r} + {b!r})' for c, w, b in zip(cols, weight, bias, strict=True)], out)} FROM {source}"


def forward_sql(p: str, net: gnn.Network, shocked: list[str]) -> str:
    """Common table expressions that end in {p}out(year, source, target, pred)."""
    hit = "'" + "', '".join(shocked or [""]) + "'"
    (w, b, g, be), second, third = net.head
    parts = [
        f"{p}fed AS (SELECT DISTINCT year, target AS node FROM edges WHERE source IN ({hit}))",
        f"{p}x AS (SELECT ns.year, ns.node, f0, f1, (ns.node IN ({hit}))::INT AS f2, (fed.node IS NOT NULL)::INT AS f3 FROM ns LEFT JOIN {p}fed fed ON fed.year = ns.year AND fed.node = ns.node)",
        f"{p}l AS (SELECT year, node, {named(dots(['f0', 'f1', 'f2', 'f3'], *net.encoder[:2]), 'h')} FROM {p}x)",
        f"{p}s0 AS ({normed(f'{p}l', 'year, node', 'h', net.encoder[2], net.encoder[3], 's')})",
    ]
    for k, layer in enumerate(net.layers):
        n, last = len(layer.bias), k + 1 == len(net.layers)
        cols = [f"s{i}" for i in range(n)]
        if isinstance(layer, gnn.Mean):
            parts.append(f"{p}m{k} AS (SELECT e.year, e.target AS node, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(cols))} FROM edges e JOIN {p}s{k} s ON s.year = e.year AND s.node = e.source GROUP BY ALL)")
            own = dots([*cols, *[f"coalesce(m{i}, 0)" for i in range(n)]], [a + c for a, c in zip(layer.own, layer.fed, strict=True)], layer.bias)
            parts.append(f"{p}c{k} AS (SELECT s.year, s.node, {named(own, 'c')} FROM {p}s{k} s LEFT JOIN {p}m{k} m ON m.year = s.year AND m.node = s.node)")
        else:
            heads = []
            for h, (matrix, send, take) in enumerate(layer.heads):
                z = dots(cols, matrix, [0.0] * n)
                parts.append(f"{p}z{k}{h} AS (SELECT year, node, {named(z, 'z')} FROM {p}s{k})")
                parts.append(f"{p}y{k}{h} AS (SELECT *, {dots(['z0', 'z1', 'z2'], [send], [0.0])[0]} AS a, {dots(['z0', 'z1', 'z2'], [take], [0.0])[0]} AS b FROM {p}z{k}{h})")
                parts.append(f"{p}r{k}{h} AS (SELECT q.year, q.target AS node, u.z0, u.z1, u.z2, u.a + v.b AS e FROM pairs q JOIN {p}y{k}{h} u ON u.year = q.year AND u.node = q.source JOIN {p}y{k}{h} v ON v.year = q.year AND v.node = q.target)")
                e = f"CASE WHEN e > 0 THEN e ELSE e * {layer.slope!r} END"
                parts.append(f"{p}o{k}{h} AS (SELECT year, node, {', '.join(f'sum(exp({e}) * z{i}) / sum(exp({e})) AS o{i}' for i in range(n))} FROM {p}r{k}{h} GROUP BY ALL)")
                heads.append(f"{p}o{k}{h}")
            mean = [f"({' + '.join(f'{t}.o{i}' for t in heads)}) / {len(heads)} + {float(layer.bias[i])!r}" for i in range(n)]
            parts.append(f"{p}c{k} AS (SELECT {heads[0]}.year, {heads[0]}.node, {named(mean, 'c')} FROM {' JOIN '.join([heads[0], *[f'{t} ON {t}.year = {heads[0]}.year AND {t}.node = {heads[0]}.node' for t in heads[1:]]])})")
        m, v, wt, bs = layer.norm
        out = [f"(c{i} - {m[i]!r}) / sqrt({v[i]!r} + 1e-5) * {wt[i]!r} + {bs[i]!r}" for i in range(n)]
        parts.append(f"{p}s{k + 1} AS (SELECT year, node, {named(out if last else [f'greatest(0, {o})' for o in out], 's')} FROM {p}c{k})")
    end = f"{p}s{len(net.layers)}"
    ins = [*[f"u.s{i}" for i in range(3)], *[f"v.s{i}" for i in range(3)], "a0", "a1", "a2", "0"]
    parts.append(f"{p}h AS (SELECT e.year, e.source, e.target, {named(dots(ins, w, b), 'h')} FROM ed e JOIN {end} u ON u.year = e.year AND u.node = e.source JOIN {end} v ON v.year = e.year AND v.node = e.target)")
    parts.append(f"{p}k AS ({normed(f'{p}h', 'year, source, target', 'h', g, be, 'k')})")
    two = [f"({d})" for d in dots(["k0", "k1", "k2"], *second)]
    parts.append(f"{p}out AS (SELECT year, source, target, ({dots(two, *third)[0]}) * {net.scale!r} + {net.shift!r} AS pred FROM {p}k)")
    return ", ".join(parts)


GRAPH = EDGES + """, ends AS (SELECT year, source AS node, value AS o, 0 AS i FROM edges UNION ALL SELECT year, target, 0, value FROM edges), ns AS (SELECT year, node, ln(1 + sum(i)) AS f0, ln(1 + sum(o)) AS f1 FROM ends GROUP BY ALL),
ed AS (SELECT year, source, target, value AS value_t, ln(1 + value) AS a0, value / sum(value) OVER (PARTITION BY year, target) AS a1, value / sum(value) OVER (PARTITION BY year, source) AS a2 FROM edges),
pairs AS (SELECT year, source, target FROM edges WHERE source <> target UNION ALL SELECT year, node, node FROM ns), """


def passed(spark, sf_dir, attention: bool) -> DataFrame:
    nodes, edges = inputs(spark, sf_dir)
    out = gnn.forward(nodes, edges, network(attention), spark.createDataFrame([(n,) for n in TRIALS[0]], "id string"))
    return rounded(out.select("year", "source", "target", "pred"), 6, "pred")


FORWARD = "SELECT year, source, target, round(pred, 6) AS pred FROM p_out"


@query(GRAPH + forward_sql("p_", network(False), TRIALS[0]) + " " + FORWARD)
def gnn_mean_ML1(spark, sf_dir):
    return passed(spark, sf_dir, False)


@query(GRAPH + forward_sql("p_", network(True), TRIALS[0]) + " " + FORWARD)
def gnn_attention_ML1(spark, sf_dir):
    return passed(spark, sf_dir, True)


#: The pass of message_passing_ML1: one layer of mean aggregation and a linear head, on one year.
LAYER = ([[0.1 if i == j else -0.02 * (i + 1) for j in range(8)] for i in range(3)], [0.1, 0.0, -0.1])
HEAD = ([[0.05, -0.1, 0.02, 0.03, 0.01, -0.04, -0.01, 0.2, 0.1, -0.5]], [0.01])
ENDS = [*[f"u.s{i}" for i in range(3)], *[f"v.s{i}" for i in range(3)], "a0", "a1", "a2", f"(e.source = '{NODE}')::INT"]
@query(GRAPH + f"""ey AS (SELECT * FROM edges WHERE year = {YEAR}), x AS (SELECT node, f0, f1, (node = '{NODE}')::INT AS f2, (node IN (SELECT target FROM ey WHERE source = '{NODE}'))::INT AS f3 FROM ns WHERE year = {YEAR}),
m AS (SELECT target AS node, avg(f0) AS m0, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3 FROM ey JOIN x ON x.node = ey.source GROUP BY target),
s AS (SELECT x.node, {named([f'greatest(0, {d})' for d in dots([*[f'f{i}' for i in range(4)], *[f'coalesce(m{i}, 0)' for i in range(4)]], *LAYER)], 's')} FROM x LEFT JOIN m ON m.node = x.node)
SELECT e.source, e.target, round(({dots(ENDS, *HEAD)[0]}) * 4.0, 6) AS pred FROM ed e JOIN s u ON u.node = e.source JOIN s v ON v.node = e.target WHERE e.year = {YEAR}""")
def message_passing_ML1(spark, sf_dir):
    nodes, edges = (t.where(F.col("year") == YEAR) for t in inputs(spark, sf_dir))
    hit, fed = F.col("node") == NODE, edges.where(F.col("source") == NODE).select("year", F.col("target").alias("node"), F.lit(1.0).alias("fed")).distinct()
    state = nodes.join(fed, ["year", "node"], "left").select("year", "node", F.concat("features", F.array(hit.cast("double"), F.coalesce("fed", F.lit(0.0)))).alias("state"))
    own, from_suppliers = ([row[at : at + 4] for row in LAYER[0]] for at in (0, 4))
    state = written(gnn.mean_layer(state, edges, gnn.Mean(own, from_suppliers, LAYER[1], ([], [], [], []))).withColumn("state", gnn.relu(F.col("state"))), "state")
    ends = edges.join(state.select("year", F.col("node").alias("source"), F.col("state").alias("s")), ["year", "source"]).join(state.select("year", F.col("node").alias("target"), F.col("state").alias("t")), ["year", "target"])
    out = gnn.linear(F.concat("s", "t", "features", F.array((F.col("source") == NODE).cast("double"))), *HEAD)
    return rounded(ends.select("source", "target", (F.get(out, F.lit(0)) * 4.0).alias("pred")), 6, "pred")


BOTH = GRAPH + forward_sql("b_", network(True), []) + ", " + forward_sql("t_", network(True), TRIALS[0])
HIT = "('" + "', '".join(TRIALS[0]) + "')"


@query(BOTH + f""", x AS (SELECT e.year, e.source, e.target, value_t, b_out.pred AS base, t_out.pred - b_out.pred AS eff FROM ed e JOIN b_out ON b_out.year = e.year AND b_out.source = e.source AND b_out.target = e.target JOIN t_out ON t_out.year = e.year AND t_out.source = e.source AND t_out.target = e.target)
SELECT source, target, round(value_t, 4) AS value_t, round(exp(ln(1 + value_t) + base) - 1, 2) AS baseline_value_t1, round(exp(ln(1 + value_t) + base + eff * (-0.2 / -0.175)) - 1, 2) AS shocked_value_t1, round(eff * (-0.2 / -0.175), 6) + 0.0 AS effect_log,
CASE WHEN source IN {HIT} AND target IN {HIT} THEN 'internal' WHEN target IN {HIT} THEN 'direct_incoming' WHEN source IN {HIT} THEN 'direct_outgoing' ELSE 'indirect' END AS edge_type FROM x""")
def simulated_shock_SH2(spark, sf_dir):
    nodes, edges = inputs(spark, sf_dir)
    out = gnn.simulate(nodes, edges, network(True), TRIALS[0], 0.2)
    return rounded(rounded(rounded(out, 2, "baseline_value_t1", "shocked_value_t1"), 6, "effect_log"), 4, "value_t").select("source", "target", "value_t", "baseline_value_t1", "shocked_value_t1", (F.col("effect_log") + 0.0).alias("effect_log"), "edge_type")


def decay_sql() -> str:
    parts, trial = [forward_sql("b_", network(False), [])], []
    for k, wanted in enumerate(TRIALS, 1):
        parts.append(forward_sql(f"t{k}_", network(False), wanted))
        hit = "'" + "', '".join(wanted) + "'"
        parts.append(f"d{k}0 AS (SELECT DISTINCT year, node FROM (SELECT DISTINCT year FROM edges) CROSS JOIN (SELECT DISTINCT node FROM ns WHERE node IN ({hit})))")
        parts.append(f"d{k}1 AS (SELECT DISTINCT e.year, target AS node FROM d{k}0 d JOIN edges e ON e.year = d.year AND e.source = d.node EXCEPT FROM d{k}0)")
        parts.append(f"d{k}2 AS (SELECT DISTINCT e.year, target AS node FROM d{k}1 d JOIN edges e ON e.year = d.year AND e.source = d.node EXCEPT FROM d{k}0 EXCEPT FROM d{k}1)")
        parts.append(f"v{k} AS (SELECT *, 0 AS hops FROM d{k}0 UNION ALL SELECT *, 1 FROM d{k}1 UNION ALL SELECT *, 2 FROM d{k}2)")
        trial.append(f"SELECT b.year, {k} AS trial, least(3, coalesce(hops, 3)) AS distance, t.pred - b.pred AS effect FROM b_out b JOIN t{k}_out t ON t.year = b.year AND t.source = b.source AND t.target = b.target LEFT JOIN v{k} v ON v.year = b.year AND v.node = b.source")
    parts.append(f"ef AS ({' UNION ALL '.join(trial)})")
    return GRAPH + ", ".join(parts)


@query(decay_sql() + " SELECT year, trial, distance, count(*) AS n_edges, round(avg(effect), 8) AS mean_effect, round(quantile_disc(effect, 0.5), 6) + 0.0 AS median_effect, round(avg((effect < -0.01)::INT) * 100, 4) AS pct_drops FROM ef GROUP BY ALL")
def simulated_decay_SH9(spark, sf_dir):
    nodes, edges = inputs(spark, sf_dir)
    out = gnn.decay(nodes, edges, network(False), [list(t) for t in TRIALS])
    return rounded(rounded(rounded(out, 8, "mean_effect"), 6, "median_effect"), 4, "pct_drops").select("year", "trial", "distance", "n_edges", "mean_effect", (F.col("median_effect") + 0.0).alias("median_effect"), "pct_drops")


# One training step: the gradient of the mean squared error of all flows that go on, clipped, and the weights after Adam's first step

RATE, DECAY_RATE = 0.01, 1e-4


def normed_back(name: str, source: str, h: str, d: list[str], weight: list[float], bias: list[float], relu_out: str, more: str = "*") -> list[str]:
    """Tables that end in {name}: with q (scaled), r (normed), e (gradient of what comes out, through the relu) and z (of what goes in)."""
    n, i = len(weight), range(len(weight))
    return [
        f"{name}_a AS (SELECT *, ({' + '.join(f'{h}{k}' for k in i)}) / {n} AS mu FROM {source})",
        f"{name}_b AS (SELECT *, sqrt(({' + '.join(f'power({h}{k} - mu, 2)' for k in i)}) / {n} + 1e-5) AS dev FROM {name}_a)",
        f"{name}_c AS (SELECT *, {named([f'({h}{k} - mu) / dev' for k in i], 'q')} FROM {name}_b)",
        f"{name}_d AS (SELECT *, {named([f'q{k} * {weight[k]!r} + {bias[k]!r}' for k in i], 'r')} FROM {name}_c)",
        f"{name}_e AS (SELECT *, {named([f'({d[k]}) * (r{k} > 0)::INT' for k in i], 'e')} FROM {name}_d)",
        f"{name} AS MATERIALIZED (SELECT *, {named([f'(e{k} * {weight[k]!r} - ({mean_of(weight, lambda j: '1')}) - q{k} * ({mean_of(weight, lambda j: f'q{j}')})) / dev' for k in i], 'z')} FROM {name}_e)",
    ]


def mean_of(weight: list[float], by) -> str:
    return "(" + " + ".join(f"e{j} * {w!r} * {by(j)}" for j, w in enumerate(weight)) + f") / {len(weight)}"


def back(columns: list[str], matrix: gnn.Matrix) -> list[str]:
    """Gradient of what goes into a dense layer, from that of what comes out."""
    return [" + ".join(f"{c} * {row[j]!r}" for c, row in zip(columns, matrix, strict=True)) for j in range(len(matrix[0]))]


def sums_of(source: str, values: dict[str, list[str]]) -> str:
    """parameter, place, g: each value summed over a table."""
    keys = [(k, i, v) for k, own in values.items() for i, v in enumerate(own)]
    return f"SELECT unnest([{', '.join(repr(k) for k, _, _ in keys)}]) AS parameter, unnest([{', '.join(str(i) for _, i, _ in keys)}]) AS place, unnest([{', '.join(f'sum({v})' for _, _, v in keys)}]) AS g FROM {source}"


def outer(a: list[str], b: list[str]) -> list[str]:
    return [f"{x} * {y}" for x in a for y in b]


def training_sql(net: gnn.Network) -> str:
    cols = lambda p, n: [f"{p}{i}" for i in range(n)]
    (w1, _, g1, s1), (w2, b2), (w3, _) = net.head
    h, last = 3, len(net.layers)
    parts = [forward_sql("p_", net, []), "tr AS (SELECT e.*, ln(1 + n.value_t) - ln(1 + e.value_t) AS td FROM ed e JOIN ed n ON n.year = e.year + 1 AND n.source = e.source AND n.target = e.target)", "yn AS (SELECT year, count(*) AS n FROM tr GROUP BY year)"]
    ins = [*[f"u.s{i} AS x{i}" for i in range(h)], *[f"v.s{i} AS x{i + h}" for i in range(h)], "a0 AS x6", "a1 AS x7", "a2 AS x8", "0.0 AS x9"]
    key = lambda a, b: f"{a}.year = {b}.year AND {a}.source = {b}.source AND {a}.target = {b}.target"
    parts.append(f"b_in AS (SELECT t.year, t.source, t.target, {', '.join(ins)}, h0, h1, h2, 2 * (pred - td) / n / (SELECT count(*) FROM yn) * {net.scale!r} AS d FROM tr t JOIN yn ON yn.year = t.year JOIN p_h ON {key('p_h', 't')} JOIN p_out o ON {key('o', 't')} JOIN p_s{last} u ON u.year = t.year AND u.node = t.source JOIN p_s{last} v ON v.year = t.year AND v.node = t.target)")
    dy = [f"(d * {w!r})" for w in w3[0]]
    parts += normed_back("b", "b_in", "h", back(dy, w2), g1, s1, "k")
    k = [f"greatest(0, r{i})" for i in range(h)]
    y = [f"({v})" for v in dots(k, w2, b2)]
    sums = [sums_of("b", {"head0.0": outer(cols("z", h), cols("x", 10)), "head0.1": cols("z", h), "head0.2": [f"e{i} * q{i}" for i in range(h)], "head0.3": cols("e", h), "head1.0": outer(dy, k), "head1.1": dy, "head2.0": [f"d * {v}" for v in y], "head2.1": ["d"]})]
    dx = back(cols("z", h), w1)
    parts.append(f"d{last} AS (SELECT year, node, {', '.join(f'sum(d{i}) AS d{i}' for i in range(h))} FROM (SELECT year, source AS node, {named(dx[:h], 'd')} FROM b UNION ALL SELECT year, target, {named(dx[h : 2 * h], 'd')} FROM b) GROUP BY ALL)")
    parts.append("sup AS (SELECT year, target AS node, count(*) AS n FROM edges GROUP BY ALL)")
    for j in range(last - 1, -1, -1):
        layer = net.layers[j]
        mean, var, weight, shift = layer.norm
        root = [f"sqrt({v!r} + 1e-5)" for v in var]
        parts.append(f"l{j}_a AS (SELECT s.year, s.node, s0, s1, s2, {', '.join(f'coalesce(m{i}, 0) AS m{i}' for i in range(h))}, {', '.join(f'(c{i} - {mean[i]!r}) / {root[i]} AS q{i}' for i in range(h))}, d0, d1, d2, coalesce(n, 1) AS n FROM p_s{j} s JOIN p_c{j} c ON c.year = s.year AND c.node = s.node JOIN d{j + 1} d ON d.year = s.year AND d.node = s.node LEFT JOIN p_m{j} m ON m.year = s.year AND m.node = s.node LEFT JOIN sup ON sup.year = s.year AND sup.node = s.node)")
        parts.append(f"l{j}_b AS (SELECT *, {named([f'd{i}' if j + 1 == last else f'd{i} * (q{i} * {weight[i]!r} + {shift[i]!r} > 0)::INT' for i in range(h)], 'e')} FROM l{j}_a)")
        parts.append(f"l{j} AS MATERIALIZED (SELECT *, {named([f'e{i} * {weight[i]!r} / {root[i]}' for i in range(h)], 'z')} FROM l{j}_b)")
        z = cols("z", h)
        sums.append(sums_of(f"l{j}", {f"layer{j}.own": outer(z, cols("s", h)), f"layer{j}.fed": outer(z, cols("m", h)), f"layer{j}.bias": z, f"layer{j}.weight": [f"e{i} * q{i}" for i in range(h)], f"layer{j}.shift": cols("e", h)}))
        along = [f"({v}) / n" for v in back(z, layer.fed)]
        parts.append(f"d{j} AS (SELECT year, node, {', '.join(f'sum(d{i}) AS d{i}' for i in range(h))} FROM (SELECT year, node, {named(back(z, layer.own), 'd')} FROM l{j} UNION ALL SELECT e.year, e.source, {named(along, 'd')} FROM edges e JOIN l{j} l ON l.year = e.year AND l.node = e.target) GROUP BY ALL)")
    parts.append("x_in AS (SELECT x.year, x.node, f0, f1, f2, f3, h0, h1, h2, d0, d1, d2 FROM p_x x JOIN p_l l ON l.year = x.year AND l.node = x.node JOIN d0 d ON d.year = x.year AND d.node = x.node)")
    parts += normed_back("x", "x_in", "h", ["d0", "d1", "d2"], net.encoder[2], net.encoder[3], "k")
    sums.append(sums_of("x", {"encoder.0": outer(cols("z", h), cols("f", 4)), "encoder.1": cols("z", h), "encoder.2": [f"e{i} * q{i}" for i in range(h)], "encoder.3": cols("e", h)}))
    old = [(n, i, v) for n, m in training.parameters(net).items() for i, v in enumerate(m.ravel().tolist())]
    parts.append(f"old AS (SELECT unnest([{', '.join(repr(n) for n, _, _ in old)}]) AS parameter, unnest([{', '.join(str(i) for _, i, _ in old)}]) AS place, unnest([{', '.join(repr(v) for _, _, v in old)}]::DOUBLE[]) AS w)")
    parts.append(f"gr AS ({' UNION ALL '.join(sums)}), cut AS (SELECT least(1.0, 1.0 / (sqrt(sum(g * g)) + 1e-6)) AS c FROM gr), st AS (SELECT parameter, place, w, g, g * c + {DECAY_RATE!r} * w AS k FROM gr JOIN old USING (parameter, place) CROSS JOIN cut)")
    return GRAPH + ", ".join(parts) + f" SELECT parameter, place::INT AS place, round(g, 6) + 0.0 AS gradient, round(w - {RATE!r} * k / (abs(k) + 1e-8), 6) + 0.0 AS weight FROM st"


@query(training_sql(network(False)))
def training_step_ML2(spark, sf_dir):
    nodes, edges = inputs(spark, sf_dir)
    after = edges.select((F.col("year") - 1).alias("year"), "source", "target", F.col("value_t").alias("value_t1"))
    rows = edges.join(after, ["year", "source", "target"]).withColumn("target_delta", F.log1p("value_t1") - F.log1p("value_t"))
    net, adam = network(False), training.Adam(RATE, DECAY_RATE)
    _, g = training.gradient(nodes.select("year", "node", F.concat("features", gnn.numbers([0.0, 0.0])).alias("x")), edges, rows, net)
    new = adam.step(training.flat(training.parameters(net)), g)
    names = [(n, i) for n, m in training.parameters(net).items() for i in range(m.size)]
    out = spark.createDataFrame([(n, i, float(a), float(b)) for (n, i), a, b in zip(names, g, new, strict=True)], "parameter string, place int, gradient double, weight double")
    return rounded(out, 6, "gradient", "weight").withColumns({c: F.col(c) + 0.0 for c in ("gradient", "weight")})
