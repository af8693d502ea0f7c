"""Queries on ports, indicators, shocks, losses, metrics, counterfactual runs and model comparisons, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalar import clip, growth
from flowloom.operators import counterfactual as C
from flowloom.operators import experiments, indicators, losses, metrics, ports, predictor, reweighted, shocks, traversal
from flowloom.operators import features as N
from flowloom.operators.edges import endpoints
from flowloom.plans.network import LABELS, NODE, OTHER, YEAR, edges_of, nodes, rounded
from flowloom.plans.sql import EDGES, NODES, Queries
from flowloom.shared import written
from flowloom.sources import trade

query = Queries()

# Ports

TRADE = """WITH trade AS (
  SELECT p_brand AS commodity, p_type AS commodity_desc, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS cty_code, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS month, l_extendedprice AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
  WHERE year(o_orderdate) = 2000 AND month(o_orderdate) BETWEEN 8 AND 10 AND l_extendedprice > 0),
wide AS (SELECT commodity, commodity_desc, cty_code, sum(value) FILTER (month = '08') AS Aug, sum(value) FILTER (month = '09') AS Sep, sum(value) FILTER (month = '10') AS Oct FROM trade GROUP BY ALL)
"""
MONEY = "round(Aug, 2) AS Aug, round(Sep, 2) AS Sep, round(Oct, 2) AS Oct"


def port_rows(spark, sf_dir) -> DataFrame:
    return ports.cleaned(trade.port_trade(spark, sf_dir))


@query(TRADE + "SELECT commodity, commodity_desc, cty_code, month, value FROM trade")
def ports_cleaned_FL7(spark, sf_dir):
    return port_rows(spark, sf_dir)


@query(TRADE + f"SELECT commodity, commodity_desc, cty_code, {MONEY} FROM wide")
def ports_pivot_P7(spark, sf_dir):
    return rounded(ports.by_month(port_rows(spark, sf_dir)), 2, "Aug", "Sep", "Oct")


@query(TRADE + f"SELECT commodity, commodity_desc, cty_code, {MONEY} FROM wide WHERE wide.Aug > wide.Sep AND wide.Oct > wide.Sep")
def ports_vshape_FL9(spark, sf_dir):
    return rounded(ports.v_shaped(ports.by_month(port_rows(spark, sf_dir))), 2, "Aug", "Sep", "Oct")


@query(TRADE + """, v AS (SELECT coalesce(Aug, 0) + coalesce(Sep, 0) + coalesce(Oct, 0) AS s, coalesce(Aug > Sep AND Oct > Sep, false) AS v FROM wide)
SELECT count(*) AS commodities, count(*) FILTER (v) AS v_commodities, round(coalesce(sum(s), 0), 2) AS total, round(coalesce(sum(s) FILTER (v), 0), 2) AS v_total, round(CASE WHEN sum(s) > 0 THEN coalesce(sum(s) FILTER (v), 0) / sum(s) * 100 ELSE 0 END, 6) AS share_pct FROM v""")
def ports_share_A8(spark, sf_dir):
    return rounded(rounded(ports.share(ports.by_month(port_rows(spark, sf_dir))), 2, "total", "v_total"), 6, "share_pct")


@query(TRADE + "SELECT CASE month WHEN '08' THEN 'Aug' WHEN '09' THEN 'Sep' ELSE 'Oct' END AS month, round(sum(value), 2) AS total FROM trade GROUP BY ALL")
def ports_by_month_A9(spark, sf_dir):
    return rounded(ports.totals_by_month(port_rows(spark, sf_dir)), 2, "total")


# Indicators: the graph lacks nations 20 to 24, and its nation 19 stands for the rest of the world.

IND = NODES + """, gn AS (SELECT DISTINCT CASE country WHEN 'N19' THEN 'ROW' ELSE country END AS country FROM nodes WHERE country < 'N20'),
acct AS (SELECT n_nationkey, n_regionkey, CAST(c_acctbal AS DECIMAL(12, 2)) AS money, y AS year FROM customer JOIN nation ON n_nationkey = c_nationkey CROSS JOIN (SELECT unnest([1998, 1999])::INT AS y)),
ind AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country, year, sum(money)::DOUBLE / count(*) + (year - 1998) AS value FROM acct WHERE n_nationkey % 7 <> 0 GROUP BY n_nationkey, year
  UNION ALL SELECT 'R' || n_regionkey, year, sum(money)::DOUBLE / count(*) + (year - 1998) FROM acct WHERE n_regionkey <> 0 GROUP BY n_regionkey, year
  UNION ALL SELECT 'WLD', year, sum(money)::DOUBLE / count(*) + (year - 1998) FROM acct GROUP BY year),
rest AS (SELECT year, avg(value) AS value FROM ind WHERE country IN (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation) AND country NOT IN (FROM gn) GROUP BY year),
filled AS (SELECT gn.country, y.year, CASE WHEN gn.country = 'ROW' THEN rest.value ELSE coalesce(own.value, CASE WHEN r.region IS NOT NULL THEN coalesce(reg.value, w.value) END) END AS value
  FROM gn CROSS JOIN (SELECT DISTINCT year FROM ind) y LEFT JOIN (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country, 'R' || n_regionkey AS region FROM nation) r ON r.country = gn.country
  LEFT JOIN ind own ON own.country = gn.country AND own.year = y.year LEFT JOIN ind reg ON reg.country = r.region AND reg.year = y.year LEFT JOIN ind w ON w.country = 'WLD' AND w.year = y.year LEFT JOIN rest ON rest.year = y.year)
"""
CODE = ("gdp_per_capita",)


def graph_nodes(spark, sf_dir) -> DataFrame:
    rows = nodes(spark, sf_dir).where("country < 'N20'")
    return rows.withColumn("id", F.when(F.col("country") == "N19", F.concat(F.lit("ROW_"), "sector")).otherwise(F.col("id")))


def filled(spark, sf_dir) -> DataFrame:
    return indicators.fill_indicators(graph_nodes(spark, sf_dir), trade.indicators(spark, sf_dir), trade.economies(spark, sf_dir), codes=CODE)


@query(IND + "SELECT 'ROW' AS country, year, 'gdp_per_capita' AS code, round(value, 6) AS value FROM rest")
def row_mean_I2(spark, sf_dir):
    return rounded(indicators.rest_of_world(trade.indicators(spark, sf_dir), graph_nodes(spark, sf_dir), trade.economies(spark, sf_dir)), 6, "value")


@query(IND + "SELECT country, year, 'gdp_per_capita' AS code, round(value, 6) AS value FROM filled")
def indicators_fill_I3(spark, sf_dir):
    return rounded(filled(spark, sf_dir), 6, "value")


#: A factor for each of the seven indicators, as the tables have one.
FACTORS = {c: 1 + 0.5 * i for i, c in enumerate(indicators.CODES)}


@query(IND + ", k AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in FACTORS) + "]) AS code, unnest([" + ", ".join(map(str, FACTORS.values())) + """]) AS factor), w AS (SELECT country, year, code, value * factor AS value FROM filled CROSS JOIN k),
p AS (SELECT country, year, """ + ", ".join(f"max(value) FILTER (code = '{c}') AS {c}" for c in FACTORS) + """ FROM w GROUP BY ALL), gx AS (SELECT CASE country WHEN 'N19' THEN 'ROW_' || sector ELSE id END AS node, CASE country WHEN 'N19' THEN 'ROW' ELSE country END AS country FROM nodes WHERE country < 'N20')
SELECT year, node, """ + ", ".join(f"round({c}, 6) AS {c}" for c in list(FACTORS)[1:]) + ", round(ln(1 + gdp_per_capita), 8) AS log_gdp_per_capita FROM gx JOIN p USING (country)")
def node_indicators_I1(spark, sf_dir):
    factors = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(f).alias("factor")) for c, f in FACTORS.items()]))
    seven = trade.indicators(spark, sf_dir).select("country", "year", "value", factors.alias("k")).select("country", "year", "k.code", (F.col("value") * F.col("k.factor")).alias("value"))
    graph = graph_nodes(spark, sf_dir)
    out = indicators.node_indicators(graph, indicators.fill_indicators(graph, seven, trade.economies(spark, sf_dir)))
    return rounded(rounded(out, 6, *list(FACTORS)[1:]), 8, "log_gdp_per_capita")


@query(IND + """SELECT year, CASE country WHEN 'N19' THEN 'ROW_' || sector ELSE id END AS node, round(ln(1 + value), 8) AS log_gdp_per_capita FROM nodes JOIN filled USING (country) WHERE country < 'N19'
UNION ALL SELECT year, 'ROW_' || sector, round(ln(1 + value), 8) FROM nodes JOIN filled ON filled.country = 'ROW' WHERE nodes.country = 'N19'""")
def log_gdp_I4(spark, sf_dir):
    return rounded(indicators.node_indicators(graph_nodes(spark, sf_dir), filled(spark, sf_dir), CODE), 8, "log_gdp_per_capita")


@query(IND + """, v AS (SELECT y.year, n.id AS node, f.value FROM (SELECT DISTINCT year FROM filled) y CROSS JOIN nodes n LEFT JOIN filled f ON f.country = n.country AND f.year = y.year AND f.country <> 'N18')
SELECT year, node, round(coalesce(value, median(value) OVER (PARTITION BY year), 0), 6) AS value FROM v""")
def median_fill_A5(spark, sf_dir):
    have = filled(spark, sf_dir).where("country <> 'N18'").select("country", "year", "value")
    years = have.select("year").distinct()
    grid = nodes(spark, sf_dir).select("country", F.col("id").alias("node")).withColumn("year", F.explode(F.array(F.lit(1998), F.lit(1999)))).join(F.broadcast(years), "year", "left_semi")
    return rounded(N.median_filled(grid.join(F.broadcast(have), ["country", "year"], "left"), ["value"]).select("year", "node", "value"), 6, "value")


# Shocks and samples

FLOWS = LABELS + ", flows AS (SELECT year, source, target, value_t, value_t1, ln(1 + value_t1) - ln(1 + value_t) AS target_delta FROM labels WHERE value_t > 0), sh AS (SELECT *, (value_t1 - value_t) / (value_t + 1e-8) < -0.15 AS shocked FROM flows)"


def flows(spark, sf_dir) -> DataFrame:
    rows = N.label_trade_drops(trade.edges(spark, sf_dir)).where("value_t > 0")
    return shocks.with_target(rows.select("year", "source", "target", "value_t", "value_t1"))


@query(FLOWS + "SELECT year, source, target, shocked FROM sh")
def edge_shock_M1(spark, sf_dir):
    return shocks.edge_shocks(flows(spark, sf_dir)).select("year", "source", "target", "shocked")


@query(FLOWS + """, n AS (SELECT year, source AS node FROM flows UNION SELECT year, target FROM flows), o AS (SELECT year, source AS node, count(*) FILTER (shocked) / (count(*) + 1e-8) > 0.2 AS s FROM sh GROUP BY ALL)
SELECT n.year, n.node, coalesce(s, false) AS shocked FROM n LEFT JOIN o ON o.year = n.year AND o.node = n.node""")
def node_shock_M2(spark, sf_dir):
    rows = shocks.edge_shocks(flows(spark, sf_dir))
    return shocks.node_shocks(rows, rows.select("year", F.explode(F.array("source", "target")).alias("node")).distinct())


@query(FLOWS + "SELECT year, source, target, round(target_delta, 8) AS target_delta FROM flows")
def target_delta_M6(spark, sf_dir):
    return rounded(flows(spark, sf_dir).select("year", "source", "target", "target_delta"), 8, "target_delta")


KINDS = FLOWS + ", k AS (SELECT year, count(*) FILTER (target_delta > 0.001) AS g, count(*) FILTER (target_delta < -0.001) AS d, count(*) FILTER (abs(target_delta) <= 0.001) AS z FROM flows GROUP BY year)"


@query(KINDS + """, t AS (SELECT *, least(g, d) AS q FROM k) SELECT * FROM (SELECT year, 'gain' AS kind, q AS n FROM t UNION ALL SELECT year, 'drop', q FROM t UNION ALL SELECT year, 'neutral', least(z, floor(q * 0.1))::BIGINT FROM t) WHERE n > 0""")
def balanced_sample_counts_M3(spark, sf_dir):
    return shocks.balanced_sample(flows(spark, sf_dir), seed=3).groupBy("year", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(KINDS + ", t AS (SELECT *, least(g, d) AS q FROM k) SELECT year, floor((q + q + least(z, floor(q * 0.1))) * 0.5)::BIGINT AS n FROM t")
def balanced_part_M5(spark, sf_dir):
    rows = written(flows(spark, sf_dir), "flows")
    part = shocks.balanced_sample(rows, seed=3, part=0.5).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    # Years of which nothing is drawn, as they have no gains or no drops, count 0.
    return rows.select("year").distinct().join(part, "year", "left").select("year", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query(FLOWS + """, c AS (SELECT year, count(*) AS n, count(*) FILTER (shocked) AS s FROM sh GROUP BY year)
SELECT year, s AS shocked, greatest(0, floor(n * 0.7)::BIGINT - s) AS normal FROM c""")
def shock_sample_counts_M4(spark, sf_dir):
    rows = shocks.shock_sample(shocks.edge_shocks(flows(spark, sf_dir)), 0.7, seed=5)
    return rows.groupBy("year").agg(F.count_if("shocked").alias("shocked"), F.count_if(~F.col("shocked")).alias("normal"))


@query(KINDS + """, f AS (SELECT *, CASE WHEN target_delta > 0.001 THEN 'gain' WHEN target_delta < -0.001 THEN 'drop' ELSE 'neutral' END AS kind FROM flows), o AS (SELECT f.*, row_number() OVER (PARTITION BY f.year, kind ORDER BY md5('3|' || source || '|' || target), source, target) AS place, least(g, d) AS q, z FROM f JOIN k ON k.year = f.year)
SELECT year, kind, source, target FROM o WHERE place <= CASE kind WHEN 'neutral' THEN least(z, floor(q * 0.1)) ELSE q END""")
def balanced_sample_M3(spark, sf_dir):
    return shocks.balanced_sample(flows(spark, sf_dir), seed=3).select("year", "kind", "source", "target")


@query(NODES + f""", en AS (SELECT source AS node FROM edges WHERE year = {YEAR} UNION SELECT target FROM edges WHERE year = {YEAR}), t AS (SELECT unnest(range(1, 21))::INT AS trial), o AS (SELECT trial, node, row_number() OVER (PARTITION BY trial ORDER BY md5('11|' || trial || '|' || node), trial, node) AS place, 5 + ('0x' || substr(md5('11|size|' || trial), 1, 8))::BIGINT % 6 AS size FROM en CROSS JOIN t)
SELECT trial, node FROM o WHERE place <= size""")
def shock_trials_M8(spark, sf_dir):
    return shocks.shock_trials(endpoints(edges_of(spark, sf_dir)), seed=11)


@query(EDGES + f"SELECT source, target, source IN ('{NODE}', '{OTHER}') AS shocked FROM edges WHERE year = {YEAR}")
def synthetic_masks_M7(spark, sf_dir):
    return shocks.synthetic_masks(edges_of(spark, sf_dir), spark.createDataFrame([(NODE,), (OTHER,)], "id string")).select("source", "target", "shocked")


# Predictions: half of last year's growth, on flows that go on

PRED = EDGES + """, pr AS (SELECT t.year, t.source, t.target, t.value AS value_t, n.value AS value_t1, greatest(-1, least(1, 0.5 * coalesce((t.value - p.value) / nullif(p.value, 0), 0))) AS pred, ln(1 + n.value) - ln(1 + t.value) AS target_delta
  FROM edges t JOIN edges n ON n.year = t.year + 1 AND n.source = t.source AND n.target = t.target LEFT JOIN edges p ON p.year = t.year - 1 AND p.source = t.source AND p.target = t.target)
"""


def predictions(spark, sf_dir, edges: DataFrame | None = None) -> DataFrame:
    """year, source, target, value_t, value_t1, pred, target_delta: one aggregation deals each edge to the three years that it matters in."""
    rows = (edges or trade.edges(spark, sf_dir))
    dealt = rows.select("source", "target", "value", F.explode(F.array(*[F.struct((F.col("year") + k).alias("year"), F.lit(k).alias("k")) for k in (-1, 0, 1)])).alias("d")).select("source", "target", "value", "d.*")
    at = lambda k: F.sum(F.when(F.col("k") == k, F.col("value")))
    sums = dealt.groupBy("year", "source", "target").agg(at(1).alias("p"), at(0).alias("value_t"), at(-1).alias("value_t1")).where("value_t IS NOT NULL AND value_t1 IS NOT NULL")
    return shocks.with_target(sums.withColumn("pred", clip(growth(F.col("value_t"), F.coalesce("p", F.lit(0.0))) * 0.5, -1.0, 1.0)).drop("p"))


SQUARE, WRONG = "(pred - target_delta) * (pred - target_delta)", "(sign(pred) <> sign(target_delta))::INT"


def mean_loss(name: str, **params: float):
    def run(spark, sf_dir):
        value = losses.loss(name, F.col("pred"), F.col("target_delta"), **params)
        return predictions(spark, sf_dir).groupBy("year").agg(F.round(F.avg(value), 8).alias("loss"))

    return run


for _name, _loss, _sql in (
    ("loss_mse_L1", "mse", SQUARE),
    ("loss_sign_L2", "sign_corrected", f"{SQUARE} * exp({WRONG})"),
    ("loss_focal_L4", "focal", f"{SQUARE} * (1 + {WRONG} * 0.5)"),
    ("loss_hybrid_L5", "hybrid", f"{SQUARE} * pow(sqrt({SQUARE} + 1e-8), 0.5) * exp({WRONG})"),
):
    query.functions[_name] = mean_loss(_loss)
    query.sql[_name] = PRED + f"SELECT year, round(avg({_sql}), 8) AS loss FROM pr GROUP BY year"


@query(PRED + f""", m AS (SELECT *, sqrt(value_t + 1) / avg(sqrt(value_t + 1)) OVER (PARTITION BY year) AS w FROM pr)
SELECT year, round(avg({SQUARE} * exp({WRONG}) * greatest(0.1, least(10, w))), 8) AS loss FROM m GROUP BY year""")
def loss_weighted_L3(spark, sf_dir):
    return rounded(losses.weighted_sign(predictions(spark, sf_dir), "value_t"), 8, "loss")


@query(PRED + f""", m AS (SELECT avg({SQUARE}) AS a, avg({SQUARE} * exp(0.5 * {WRONG})) AS b, avg({SQUARE} * exp({WRONG})) AS c, avg({SQUARE} * exp(2 * {WRONG})) AS d, avg({SQUARE} * (1 + {WRONG} * 0.5)) AS e, avg({SQUARE} * pow(sqrt({SQUARE} + 1e-8), 0.5) * exp({WRONG})) AS f, avg(1 - {WRONG}) AS right_sign, avg(abs(pred - target_delta)) AS mae FROM pr)
SELECT loss, round(value, 8) AS value, round(value / a, 8) AS relative, round(right_sign, 8) AS direction_acc, round(mae, 8) AS mae FROM (SELECT *, unnest(['mse', 'sign_corrected alpha=0.5', 'sign_corrected alpha=1.0', 'sign_corrected alpha=2.0', 'focal gamma=1.0', 'hybrid']) AS loss, unnest([a, b, c, d, e, f]) AS value FROM m)""")
def loss_compare_L6(spark, sf_dir):
    return rounded(losses.compare_losses(predictions(spark, sf_dir)), 8, "value", "relative", "direction_acc", "mae")


@query(PRED + """, m AS (SELECT *, target_delta - pred AS e, exp(ln(1 + value_t) + pred) - 1 AS guess FROM pr)
SELECT year, round(avg(e * e), 8) AS mse, round(sqrt(avg(e * e)), 8) AS rmse, round(avg(abs(e)), 8) AS mae, round(1 - sum(e * e) / (count(*) * var_pop(target_delta)), 8) AS r2, round(avg(abs(guess - value_t1) / greatest(abs(value_t1), 1e-6)) * 100, 6) AS mape, round(avg(2 * abs(guess - value_t1) / (abs(guess) + abs(value_t1) + 1e-6)) * 100, 6) AS smape FROM m GROUP BY year""")
def metrics_regression_A22(spark, sf_dir):
    return rounded(rounded(metrics.regression_metrics(predictions(spark, sf_dir)), 8, "mse", "rmse", "mae", "r2"), 6, "mape", "smape")


SIGNS = PRED + ", s AS (SELECT *, CASE WHEN abs(pred) < {eps} THEN 0 ELSE sign(pred) END AS sp, CASE WHEN abs(target_delta) < {eps} THEN 0 ELSE sign(target_delta) END AS st FROM pr)"


@query(SIGNS.replace("{eps}", "1e-3") + """, c AS (SELECT year, avg((sp = st)::INT) AS a, coalesce(avg((sp = st)::INT) FILTER (target_delta > 1e-3), 0) AS g, coalesce(avg((sp = st)::INT) FILTER (target_delta < -1e-3), 0) AS d, count(*) FILTER (sp < 0 AND st < 0) / (count(*) FILTER (sp < 0) + 1e-8) AS p, count(*) FILTER (sp < 0 AND st < 0) / (count(*) FILTER (st < 0) + 1e-8) AS r FROM s GROUP BY year)
SELECT year, round(a, 8) AS direction_acc, round(g, 8) AS gain_dir_acc, round(d, 8) AS drop_dir_acc, round(p, 8) AS drop_precision, round(r, 8) AS drop_recall, round(2 * p * r / (p + r + 1e-8), 8) AS drop_f1 FROM c""")
def metrics_direction_A23(spark, sf_dir):
    out = metrics.direction_metrics(predictions(spark, sf_dir))
    return rounded(out, 8, *out.columns[1:])


@query(PRED + "SELECT year, " + ", ".join(f"round(avg(({c} {op})::INT), 8) AS {n}_{k}_frac" for n, c in (("target", "target_delta"), ("pred", "pred")) for k, op in (("neg", "< -1e-3"), ("pos", "> 1e-3"))) + ", " + ", ".join(f"round(avg((abs({c}) <= 1e-3)::INT), 8) AS {n}_zero_frac" for n, c in (("target", "target_delta"), ("pred", "pred"))) + " FROM pr GROUP BY year")
def metrics_sign_dist_A24(spark, sf_dir):
    out = metrics.sign_distribution(predictions(spark, sf_dir))
    return rounded(out, 8, *out.columns[1:])


YEARLY = """round(avg((sp = st)::INT), 8) AS direction_acc, round(coalesce(avg((sp = st)::INT) FILTER (target_delta > 1e-4), 0), 8) AS gain_dir_acc, round(coalesce(avg((sp = st)::INT) FILTER (target_delta < -1e-4), 0), 8) AS drop_dir_acc,
round(1 - sum(power(target_delta - pred, 2)) / (count(*) * var_pop(target_delta)), 8) AS r2, round(sqrt(avg(power(target_delta - pred, 2))), 8) AS rmse, round(avg(abs(target_delta - pred)), 8) AS mae,
round(avg(target_delta), 8) AS target_mean, round(avg(pred), 8) AS pred_mean, round(stddev_pop(target_delta), 8) AS target_std, round(stddev_pop(pred), 8) AS pred_std,
round(avg((target_delta < -1e-4)::INT) * 100, 6) AS target_neg_pct, round(avg((target_delta > 1e-4)::INT) * 100, 6) AS target_pos_pct, round(avg((pred < -1e-4)::INT) * 100, 6) AS pred_neg_pct, round(avg((pred > 1e-4)::INT) * 100, 6) AS pred_pos_pct,
count(*) FILTER (target_delta < -1e-4 AND pred > 1e-4) AS false_positive, count(*) FILTER (target_delta > 1e-4 AND pred < -1e-4) AS false_negative, round(count(*) FILTER (target_delta < -1e-4 AND pred > 1e-4) / (count(*) FILTER (target_delta > 1e-4 AND pred < -1e-4) + 1e-8), 6) AS fp_fn_ratio, count(*) AS n_samples"""
SIX = ("target_neg_pct", "target_pos_pct", "pred_neg_pct", "pred_pos_pct", "fp_fn_ratio")
EIGHT = ("direction_acc", "gain_dir_acc", "drop_dir_acc", "r2", "rmse", "mae", "target_mean", "pred_mean", "target_std", "pred_std")


@query(SIGNS.replace("{eps}", "1e-4") + f"SELECT year, {YEARLY} FROM s GROUP BY year")
def metrics_year_A25(spark, sf_dir):
    return rounded(rounded(metrics.year_metrics(predictions(spark, sf_dir)), 8, *EIGHT), 6, *SIX)


@query(PRED + ", e AS (SELECT *, CASE WHEN abs(pred) < 1e-3 THEN 0 ELSE sign(pred) END = CASE WHEN abs(target_delta) < 1e-3 THEN 0 ELSE sign(target_delta) END AS ok FROM pr) SELECT count(*) FILTER (ok) AS correct, count(*) AS total, round(count(*) FILTER (ok) / count(*), 8) AS direction_acc FROM e")
def direction_total_A26(spark, sf_dir):
    from flowloom.functions.scalar import dead_sign

    ok = dead_sign(F.col("pred"), 1e-3) == dead_sign(F.col("target_delta"), 1e-3)
    out = predictions(spark, sf_dir).agg(F.count_if(ok).alias("correct"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("direction_acc", F.round(F.col("correct") / F.col("total"), 8))


# Models to compare: half, a quarter and none of last year's growth

MODELS = {"half": 0.5, "quarter": 0.25, "flat": 0.0}
MM = PRED + ", mp AS (SELECT year, unnest(['half', 'quarter', 'flat']) AS model, unnest([pred, pred * 0.5, 0.05]) AS pred, target_delta FROM pr), s AS (SELECT *, CASE WHEN abs(pred) < 1e-4 THEN 0 ELSE sign(pred) END AS sp, CASE WHEN abs(target_delta) < 1e-4 THEN 0 ELSE sign(target_delta) END AS st FROM mp)" + f", m AS (SELECT year, model, {YEARLY} FROM s GROUP BY year, model)"


def model_metrics(spark, sf_dir) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("pred")) for m, p in (("half", F.col("pred")), ("quarter", F.col("pred") * 0.5), ("flat", F.lit(0.05)))]))
    rows = predictions(spark, sf_dir).select("year", "target_delta", each.alias("m")).select(F.struct("year", "m.model").alias("key"), "target_delta", "m.pred")
    out = metrics.year_metrics(rows, group="key").select("key.*", "*").drop("key")
    return rounded(rounded(out, 8, *EIGHT), 6, *SIX)


def pivots(metric: str):
    return lambda spark, sf_dir: experiments.model_pivot(model_metrics(spark, sf_dir), metric, list(MODELS))


for _m in experiments.METRICS:
    query.functions[f"model_pivot_{_m}_P8"] = pivots(_m)
    query.sql[f"model_pivot_{_m}_P8"] = MM + "SELECT year, " + ", ".join(f"max({_m}) FILTER (model = '{x}') AS {x}" for x in MODELS) + " FROM m GROUP BY year"


@query(MM + "SELECT model, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in experiments.METRICS) + " FROM m GROUP BY model")
def model_mean_A19(spark, sf_dir):
    return rounded(experiments.model_means(model_metrics(spark, sf_dir)), 6, *experiments.METRICS)


@query(MM + ", a AS (SELECT model, " + ", ".join(f"avg({c}) AS {c}" for c in experiments.METRICS) + " FROM m GROUP BY model)" + ", u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, model, {c} AS value, {-1 if c in experiments.LESS else 1} AS way FROM a" for c in experiments.METRICS) + ") SELECT metric, model, round(value, 6) AS value FROM u QUALIFY row_number() OVER (PARTITION BY metric ORDER BY round(value * way, 9) DESC, model) = 1")
def best_model_A20(spark, sf_dir):
    means = experiments.model_means(model_metrics(spark, sf_dir))
    return rounded(experiments.best_models(rounded(means, 9, *experiments.METRICS)), 6, "value")


def results(spark, sf_dir) -> DataFrame:
    """What results files hold: a row for each year, as if each were a loss."""
    p = predictions(spark, sf_dir)
    rows = metrics.regression_metrics(p).join(metrics.direction_metrics(p), "year").join(metrics.sign_distribution(p), "year")
    names = ("direction_acc", "gain_dir_acc", "drop_dir_acc", "drop_f1", "r2", "rmse", "mae", "smape", "target_neg_frac", "pred_neg_frac")
    return rows.select(F.concat(F.lit("y"), "year").alias("loss"), F.struct(*[F.round(c, 8).alias(c) for c in names]).alias("test_metrics"), F.when(F.col("year") > 1997, F.col("year") - 1997).alias("best_epoch"))


@query(SIGNS.replace("{eps}", "1e-3") + """, m AS (SELECT *, exp(ln(1 + value_t) + pred) - 1 AS guess FROM s), c AS (SELECT year, round(avg((sp = st)::INT), 8) AS a, round(1 - sum(power(target_delta - pred, 2)) / (count(*) * var_pop(target_delta)), 8) AS r2, round(sqrt(avg(power(target_delta - pred, 2))), 8) AS rmse,
round(avg(2 * abs(guess - value_t1) / (abs(guess) + abs(value_t1) + 1e-6)) * 100, 8) AS smape, round(avg((pred < -1e-3)::INT), 8) AS p FROM m GROUP BY year)
SELECT 'y' || year AS loss, printf('%.2f', a * 100) || '%' AS direction_acc, printf('%.4f', r2) AS r2, printf('%.4f', rmse) AS rmse, printf('%.1f', smape) || '%' AS smape, printf('%.2f', p * 100) || '%' AS pred_neg_frac, CASE WHEN year > 1997 THEN CAST(year - 1997 AS VARCHAR) ELSE 'N/A' END AS best_epoch FROM c""")
def metric_table_P11(spark, sf_dir):
    return experiments.metric_table(results(spark, sf_dir)).select("loss", "direction_acc", "r2", "rmse", "smape", "pred_neg_frac", "best_epoch")


@query(SIGNS.replace("{eps}", "1e-3") + """, c AS (SELECT year, coalesce(avg((sp = st)::INT) FILTER (target_delta > 1e-3), 0) AS g, coalesce(avg((sp = st)::INT) FILTER (target_delta < -1e-3), 0) AS d, 1 - sum(power(target_delta - pred, 2)) / (count(*) * var_pop(target_delta)) AS r2 FROM s GROUP BY year)
SELECT 'y' || year AS loss, round(g, 8) AS gain_dir_acc, round(d, 8) AS drop_dir_acc, round(r2, 8) AS r2 FROM c""")
def plot_metrics_S20(spark, sf_dir):
    return experiments.plotted(results(spark, sf_dir))


# Counterfactual runs on 1998: the shock's effect falls with the distance and grows with the flow

SHOCK = PRED + f""", e AS (SELECT source, target FROM edges WHERE year = {YEAR}), l0 AS (SELECT unnest(['{NODE}', '{OTHER}']) AS node), l1 AS (SELECT DISTINCT target AS node FROM e WHERE source IN (FROM l0) AND target NOT IN (FROM l0)), l2 AS (SELECT DISTINCT target AS node FROM e WHERE source IN (FROM l1) AND target NOT IN (FROM l0) AND target NOT IN (FROM l1)),
lv AS (SELECT node, 0 AS hops FROM l0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2),
x AS (SELECT source, target, value_t, pred AS base, -0.3 / (1 + least(3, coalesce(hops, 3))) * least(1, value_t / 100000) AS eff0, least(3, coalesce(hops, 3)) AS distance FROM pr LEFT JOIN lv ON node = source WHERE year = {YEAR}),
v AS (SELECT source, target, value_t, distance, eff0, eff0 * (-0.5 / -0.175) AS effect, exp(ln(1 + value_t) + base) - 1 AS b, exp(ln(1 + value_t) + base + eff0 * (-0.5 / -0.175)) - 1 AS a FROM x),
r AS (SELECT *, a - b AS change, (a - b) / (b + 1e-8) * 100 AS pct, CASE WHEN source IN (FROM l0) AND target IN (FROM l0) THEN 'internal' WHEN target IN (FROM l0) THEN 'direct_incoming' WHEN source IN (FROM l0) THEN 'direct_outgoing' ELSE 'indirect' END AS edge_type FROM v)
"""


def both_runs(spark, sf_dir) -> DataFrame:
    """source, target, value_t, distance, baseline_delta, shocked_delta."""
    rows = predictions(spark, sf_dir).where(F.col("year") == YEAR)
    level = traversal.hops(edges_of(spark, sf_dir), spark.createDataFrame([(NODE,), (OTHER,)], "node string"), 2)
    distance = F.least(F.lit(3), F.coalesce("hops", F.lit(3)))
    rows = rows.join(level.withColumnRenamed("node", "source"), "source", "left").withColumn("distance", distance)
    return rows.select("source", "target", "value_t", "distance", F.col("pred").alias("baseline_delta"), (F.col("pred") - 0.3 / (1 + F.col("distance")) * F.least(F.lit(1.0), F.col("value_t") / 100000)).alias("shocked_delta"))


def shock(spark, sf_dir) -> DataFrame:
    return C.simulate_shock(both_runs(spark, sf_dir), [NODE, OTHER], 0.5)


@query(SHOCK + "SELECT source, target, round(b, 4) AS baseline_value_t1, round(a, 4) AS shocked_value_t1, round(change, 4) AS absolute_change, round(pct, 6) AS pct_change FROM r")
def shock_results_SH3(spark, sf_dir):
    out = shock(spark, sf_dir).select("source", "target", "baseline_value_t1", "shocked_value_t1", "absolute_change", "pct_change")
    return rounded(rounded(out, 4, "baseline_value_t1", "shocked_value_t1", "absolute_change"), 6, "pct_change")


@query(SHOCK + "SELECT source, target, split_part(source, '_', 1) AS source_country, split_part(target, '_', 2) AS target_sector, edge_type FROM r")
def shock_edge_type_SH4(spark, sf_dir):
    return shock(spark, sf_dir).select("source", "target", "source_country", "target_sector", "edge_type")


def rollup(key: str):
    return lambda spark, sf_dir: rounded(rounded(C.impact_by(shock(spark, sf_dir), key).withColumnRenamed(key, "key"), 4, "total_change", "value_t"), 6, "mean_pct")


ROLLED = "round(sum(change), 4) AS total_change, round(avg(pct), 6) AS mean_pct, round(sum(value_t), 4) AS value_t"
for _name, _key, _sql in (("shock_country_A11", "target_country", "split_part(target, '_', 1)"), ("shock_sector_A11", "target_sector", "split_part(target, '_', 2)"), ("shock_node_A11", "target", "target")):
    query.functions[_name] = rollup(_key)
    query.sql[_name] = SHOCK + f"SELECT {_sql} AS key, {ROLLED} FROM r GROUP BY key ORDER BY abs(sum(change)) DESC, key LIMIT 10"


@query(SHOCK + f"""SELECT 'country' AS level, split_part(target, '_', 1) AS key, {ROLLED} FROM r GROUP BY key UNION ALL SELECT 'sector', split_part(target, '_', 2) AS key, {ROLLED} FROM r GROUP BY key UNION ALL SELECT 'node', target AS key, {ROLLED} FROM r GROUP BY key""")
def shock_impacts_SH6(spark, sf_dir):
    return rounded(rounded(C.impacts(shock(spark, sf_dir)), 4, "total_change", "value_t"), 6, "mean_pct")


@query(SHOCK + "SELECT edge_type, count(*) AS edges, round(sum(value_t), 4) AS value_t, round(avg(pct), 6) AS mean_pct, round(sum(change), 4) AS total_change, round(median(pct), 6) AS median_pct FROM r WHERE edge_type <> 'indirect' GROUP BY edge_type")
def shock_blocks_A12(spark, sf_dir):
    return rounded(rounded(C.direct_blocks(shock(spark, sf_dir)), 4, "value_t", "total_change"), 6, "mean_pct", "median_pct")


@query(SHOCK + "SELECT count(*) AS edges, count(*) FILTER (abs(pct) > 1) AS over_1_pct, count(*) FILTER (abs(pct) > 5) AS over_5_pct, count(*) FILTER (abs(pct) > 10) AS over_10_pct, round(max(abs(pct)), 6) AS greatest, round(avg(pct), 6) AS mean_pct, round(stddev_samp(pct), 6) AS deviation FROM r WHERE edge_type = 'indirect'")
def shock_indirect_A13(spark, sf_dir):
    return rounded(C.indirect_block(shock(spark, sf_dir)), 6, "greatest", "mean_pct", "deviation")


@query(SHOCK + "SELECT source, target, edge_type, round(abs(change), 4) AS abs_change FROM r ORDER BY abs(change) DESC, source, target LIMIT 15")
def shock_top15_T6(spark, sf_dir):
    return rounded(C.strongest(shock(spark, sf_dir), 15).select("source", "target", "edge_type", "abs_change"), 4, "abs_change")


@query(SHOCK + f"""SELECT '{NODE},{OTHER}' AS shocked_nodes, -0.5::DOUBLE AS magnitude, count(*) AS total_edges, count(*) FILTER (edge_type = 'direct_outgoing') AS direct_outgoing, count(*) FILTER (edge_type = 'direct_incoming') AS direct_incoming, count(*) FILTER (edge_type = 'indirect') AS indirect,
round(sum(change), 4) AS total_impact, round(avg(pct), 6) AS mean_pct_change, round(median(pct), 6) AS median_pct_change, count(*) FILTER (abs(pct) > 1) AS edges_affected_1pct, count(*) FILTER (abs(pct) > 5) AS edges_affected_5pct, count(*) FILTER (abs(pct) > 10) AS edges_affected_10pct FROM r""")
def shock_summary_SH8(spark, sf_dir):
    out = C.shock_summary(shock(spark, sf_dir), [NODE, OTHER], 0.5)
    return rounded(rounded(out, 4, "total_impact"), 6, "mean_pct_change", "median_pct_change")


@query(SHOCK + f"SELECT round(avg(eff0) FILTER (source IN (FROM l0)), 8) AS direct_effect_mean, round(avg(eff0) FILTER (source NOT IN (FROM l0)), 8) AS indirect_effect_mean, count(*) FILTER (abs(eff0) > 0.01) AS total_affected_edges FROM r")
def effect_summary_ML5(spark, sf_dir):
    return rounded(C.effect_summary(both_runs(spark, sf_dir), [NODE, OTHER]), 8, "direct_effect_mean", "indirect_effect_mean")


# Trials: each shocks the nodes whose place in the order of names has one remainder

TRIALS = 12
DECAY = PRED + f""", en AS (SELECT DISTINCT year, source, target FROM edges), nn AS (SELECT node, (row_number() OVER (ORDER BY node) - 1) % {TRIALS} + 1 AS trial FROM (SELECT source AS node FROM edges UNION SELECT target FROM edges)), yy AS (SELECT DISTINCT year FROM pr),
h0 AS (SELECT yy.year, trial, node FROM nn CROSS JOIN yy), h1 AS (SELECT DISTINCT en.year, trial, target AS node FROM h0 JOIN en ON en.year = h0.year AND source = node EXCEPT FROM h0), h2 AS (SELECT DISTINCT en.year, trial, target AS node FROM h1 JOIN en ON en.year = h1.year AND source = node EXCEPT FROM h0 EXCEPT FROM h1),
hv AS (SELECT *, 0 AS hops FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2),
ef AS (SELECT pr.year, t.trial, least(3, coalesce(hops, 3))::INT AS distance, -0.3 / (1 + least(3, coalesce(hops, 3))) * least(1, value_t / 100000) AS effect FROM pr CROSS JOIN (SELECT unnest(range(1, {TRIALS} + 1)) AS trial) t LEFT JOIN hv ON hv.year = pr.year AND hv.trial = t.trial AND hv.node = pr.source),
dc AS (SELECT year, trial::INT AS trial, distance, count(*) AS n_edges, avg(effect) AS mean_effect, quantile_disc(effect, 0.5) AS median_effect, stddev_samp(effect) AS std_effect, avg((effect < -0.01)::INT) * 100 AS pct_drops, avg((abs(effect) > 0.01)::INT) * 100 AS pct_significant FROM ef GROUP BY ALL),
tm AS (SELECT year, distance, avg(n_edges) AS n_edges, avg(mean_effect) AS mean_effect, median(median_effect) AS median_effect, avg(pct_drops) AS pct_drops, avg(pct_significant) AS pct_significant FROM dc GROUP BY ALL),
ym AS (SELECT distance, avg(mean_effect) AS mean_effect, avg(pct_drops) AS pct_drops FROM tm GROUP BY ALL)
"""


def decay(spark, sf_dir) -> DataFrame:
    edges = written(trade.edges(spark, sf_dir), "edges")
    rows = predictions(spark, sf_dir, edges)
    starts = N.node_index(endpoints(edges)).select((F.col("idx") % TRIALS).alias("trial"), "node").join(F.broadcast(rows.select("year").distinct()))
    level = traversal.reach(edges, starts, 2, ("year",)).withColumnRenamed("node", "source")
    rows = traversal.with_distances(rows, level, TRIALS, 3, ("year",)).withColumn("trial", (F.col("trial") + 1).cast("int"))
    return C.hop_decay(rows.select("year", "trial", "distance", (-0.3 / (1 + F.col("distance")) * F.least(F.lit(1.0), F.col("value_t") / 100000)).alias("effect")))


@query(DECAY + "SELECT year, trial, distance, n_edges, round(mean_effect, 8) AS mean_effect, round(median_effect, 8) AS median_effect, round(std_effect, 8) AS std_effect, round(pct_drops, 6) AS pct_drops, round(pct_significant, 6) AS pct_significant FROM dc")
def hop_decay_A15(spark, sf_dir):
    return rounded(rounded(decay(spark, sf_dir), 8, "mean_effect", "median_effect", "std_effect"), 6, "pct_drops", "pct_significant")


@query(DECAY + "SELECT year, distance, round(n_edges, 6) AS n_edges, round(mean_effect, 8) AS mean_effect, round(median_effect, 8) AS median_effect, round(pct_drops, 6) AS pct_drops, round(pct_significant, 6) AS pct_significant FROM tm")
def trial_mean_A16(spark, sf_dir):
    return rounded(rounded(C.over_trials(decay(spark, sf_dir)), 8, "mean_effect", "median_effect"), 6, "n_edges", "pct_drops", "pct_significant")


@query(DECAY + "SELECT distance, round(mean_effect, 8) AS mean_effect, round(pct_drops, 6) AS pct_drops FROM ym")
def year_mean_A17(spark, sf_dir):
    return rounded(rounded(C.over_years(C.over_trials(decay(spark, sf_dir))), 8, "mean_effect"), 6, "pct_drops")


@query(DECAY + """, cb AS (SELECT avg(mean_effect) FILTER (year IN (1997, 1999)) AS c, avg(mean_effect) FILTER (year = 1998) AS b FROM tm WHERE distance = 1)
SELECT round(c, 8) AS crisis_effect, round(b, 8) AS boom_effect, CASE WHEN abs(c) > abs(b) * 1.3 THEN 'stronger in crisis' WHEN abs(c) < abs(b) * 0.7 THEN 'weaker in crisis' WHEN c IS NOT NULL AND b IS NOT NULL THEN 'similar' END AS verdict FROM cb""")
def crisis_boom_A18(spark, sf_dir):
    return rounded(C.crisis_and_boom(C.over_trials(decay(spark, sf_dir)), (1997, 1999), (1998,)), 8, "crisis_effect", "boom_effect")


@query(DECAY + """, o AS (SELECT max(mean_effect) FILTER (distance = 0) AS d, max(mean_effect) FILTER (distance = 1) AS h FROM ym)
SELECT round(d, 8) AS direct_effect, round(h, 8) AS hop1_effect, abs(d) > 0.01 AS responds, abs(h) > 0.005 AS propagates, CASE WHEN abs(h) > 0.005 THEN round(coalesce(h / nullif(d, 0), 0), 6) END AS ratio FROM o""")
def verdict_SH10(spark, sf_dir):
    out = C.verdicts(C.over_years(C.over_trials(decay(spark, sf_dir))))
    return rounded(rounded(out, 8, "direct_effect", "hop1_effect"), 6, "ratio")


# Models

@query(EDGES + """, st AS (SELECT year, source AS node, value AS o FROM edges), a AS (SELECT year, node, sum(o) AS o FROM st GROUP BY ALL)
SELECT e.year, e.target AS node, round(avg(ln(1 + a.o)), 8) AS strength_hop1 FROM edges e JOIN a ON a.year = e.year AND a.node = e.source GROUP BY ALL""")
def neighbour_mean_J16(spark, sf_dir):
    rows = trade.edges(spark, sf_dir)
    strength = N.node_strengths(rows).select("year", "node", F.log1p("out_strength").alias("strength"), "in_degree")
    return rounded(predictor.neighbour_means(rows, strength, ["strength"]).where("in_degree > 0").select("year", "node", "strength_hop1"), 8, "strength_hop1")


def growth_rows(spark, sf_dir) -> DataFrame:
    """Flows that go on, with the logarithm of the value and half of last year's growth to fit from."""
    return predictions(spark, sf_dir).withColumns({"log_value": F.log1p("value_t"), "growth": F.col("pred")}).drop("pred")


@query()
def predictor_ML2(spark, sf_dir):
    rows = growth_rows(spark, sf_dir)
    model = predictor.EdgeRegression(["log_value", "growth"]).fit(rows.where("year < 1999"))
    return model.predict(rows).select("year", "source", "target", F.round("pred", 6).alias("pred"))


# Fits under the losses: squares first, then one full round of weights at that fit; normal equations by Cramer's rule

def solved_sql(name: str, source: str, weight: str) -> str:
    """A table of c0, c1, c2: the weighted fit of t by 1, a and g."""
    x = ("1", "a", "g")
    sums = [f"sum(({weight}) * {x[i]} * {x[j]}) AS s{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(({weight}) * {x[i]} * t) AS r{i}" for i in range(3)]
    s = [[f"s{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]

    def det(m: list[list[str]]) -> str:
        return "(" + " + ".join(f"{m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})" for i in range(3)) + ")"

    parts = [f"{det([[f'r{i}' if j == k else s[i][j] for j in range(3)] for i in range(3)])} / {det(s)} AS c{k}" for k in range(3)]
    return f"{name}_s AS (SELECT {', '.join(sums)} FROM {source}), {name} AS (SELECT {', '.join(parts)} FROM {name}_s)"


FIT_ERROR, FIT_WRONG = "(p - t)", "(sign(p) <> sign(t))::INT"
FIT_WEIGHTS = {
    "sign_corrected": f"exp({FIT_WRONG})", "focal": f"1 + {FIT_WRONG} * 0.5",
    "hybrid": f"exp({FIT_WRONG}) * (power({FIT_ERROR} * {FIT_ERROR} + 1e-8, 0.25) + 0.25 * {FIT_ERROR} * {FIT_ERROR} * power({FIT_ERROR} * {FIT_ERROR} + 1e-8, -0.75))",
}


@query(PRED + ", x AS (SELECT ln(1 + value_t) AS a, pred AS g, target_delta AS t FROM pr), " + solved_sql("mse", "x", "1") + ", y AS (SELECT a, g, t, c0 + c1 * a + c2 * g AS p FROM x CROSS JOIN mse), " + ", ".join(solved_sql(k, "y", w) for k, w in FIT_WEIGHTS.items())
       + " SELECT loss, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2 FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS loss, * FROM {k}" for k in ("mse", *FIT_WEIGHTS)) + ")")
def fit_under_losses_L2(spark, sf_dir):
    rows = written(growth_rows(spark, sf_dir), "growth")
    out = []
    for name in ("mse", *FIT_WEIGHTS):
        model = reweighted.Reweighted(["log_value", "growth"], name).fit(rows, rounds=1, parts=(1.0,), least=-1e9)
        out.append((name, *model.coefficients))
    return rounded(spark.createDataFrame(out, "loss string, c0 double, c1 double, c2 double"), 6, "c0", "c1", "c2")
