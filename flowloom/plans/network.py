"""Queries on the trade network: edges, vertices, graph queries, features and labels. Each has its SQL beside it.

Sums of money are rounded to the 4 decimals that they have, ratios and logarithms to 8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import edges as E
from flowloom.operators import features as N
from flowloom.operators import graph as G
from flowloom.operators import maintenance, traversal
from flowloom.plans.sql import EDGES, NODES, WITH, Queries
from flowloom.sources.trade import edges as all_edges

YEAR, NODE, OTHER = 1998, "N09_S1", "N03_S2"
LARGE = 141000.0
query = Queries()
NAMES = [f"N{n:02d}_S{s}" for n in range(25) for s in range(5)]


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def edges_of(spark, sf_dir, year: int = YEAR) -> DataFrame:
    return all_edges(spark, sf_dir).where(F.col("year") == year)


def nodes(spark, sf_dir) -> DataFrame:
    return E.vertices(E.endpoints(all_edges(spark, sf_dir)))


def wide(spark, sf_dir) -> DataFrame:
    """The year's matrix with a row of value added and columns of final use and output, and negative cells."""
    rows = edges_of(spark, sf_dir).withColumn("value", F.col("value") - 50000)
    out = rows.groupBy(F.col("source").alias("V1")).pivot("target", NAMES).agg(F.first("value"))
    return out.withColumns({"N00_HFCE": F.lit(1.0), "OUT": F.lit(2.0)})


@query(EDGES + "SELECT year, source, target, value FROM edges")
def edges_by_year(spark, sf_dir):
    return all_edges(spark, sf_dir)


@query(WITH("m") + "SELECT source, target, value FROM m WHERE abs(value) >= 1000")
def melt_rectangular_P1(spark, sf_dir):
    matrix = wide(spark, sf_dir)
    return rounded(E.melt_rectangular(matrix, "V1", E.sector_columns(matrix.columns), 1000), 4, "value")


@query(WITH("m") + "SELECT source, target, value FROM m WHERE value > 0")
def melt_square_P2(spark, sf_dir):
    matrix = wide(spark, sf_dir)
    return rounded(E.melt_square(matrix, "V1", E.sector_columns(matrix.columns)), 4, "value")


@query(WITH("m") + "SELECT source, target, value FROM m WHERE abs(value) >= 25000")
def edge_threshold_FL1(spark, sf_dir):
    rows = edges_of(spark, sf_dir).select("source", "target", F.round(F.col("value") - 50000, 4).alias("value"))
    return rows.where(F.abs("value") >= 25000)


@query(NODES + "SELECT id, label, pk, country, sector, id_str FROM nodes")
def vertices_P3(spark, sf_dir):
    return nodes(spark, sf_dir)


@query(EDGES + """, s AS (SELECT year, source AS node, value AS o, NULL::DOUBLE AS i FROM edges UNION ALL SELECT year, target, NULL, value FROM edges)
SELECT year, node, round(coalesce(sum(i), 0), 4) AS in_strength, round(coalesce(sum(o), 0), 4) AS out_strength FROM s GROUP BY ALL""")
def node_strength_A1(spark, sf_dir):
    return rounded(N.node_strengths(all_edges(spark, sf_dir)).select("year", "node", "in_strength", "out_strength"), 4, "in_strength", "out_strength")


@query(EDGES + """, s AS (SELECT year, source AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT year, target, 0, 1 FROM edges)
SELECT year, node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM s GROUP BY ALL""")
def node_degree_A2(spark, sf_dir):
    return N.node_strengths(all_edges(spark, sf_dir)).select("year", "node", "in_degree", "out_degree")


@query(NODES + "SELECT (SELECT count(*) FROM nodes) AS vertices, (SELECT count(*) FROM edges) AS edges")
def graph_stats_G9(spark, sf_dir):
    return G.graph_stats(nodes(spark, sf_dir), all_edges(spark, sf_dir))


@query(NODES + f"SELECT count(*) > 0 AS found FROM nodes WHERE id = '{NODE}'")
def node_exists_G1(spark, sf_dir):
    return G.node_exists(nodes(spark, sf_dir), NODE)


@query(NODES + f"SELECT id, country AS country_value, sector AS sector_value FROM nodes WHERE id = '{NODE}'")
def node_properties_G2(spark, sf_dir):
    p = F.col("properties")
    return G.node_properties(nodes(spark, sf_dir), NODE).select("id", F.get(p["country"], F.lit(0)).alias("country_value"), F.get(p["sector"], F.lit(0)).alias("sector_value"))


@query(NODES + "SELECT id FROM nodes ORDER BY md5('7|' || id), id LIMIT 1")
def random_node_G3(spark, sf_dir):
    return G.random_node(nodes(spark, sf_dir), seed=7)


@query(EDGES + f"SELECT year, source, target, value FROM edges WHERE year = {YEAR} ORDER BY source, target LIMIT 1")
def first_edge_G4(spark, sf_dir):
    return G.first_edge(edges_of(spark, sf_dir))


@query(EDGES + f"SELECT min(value) AS value FROM edges WHERE year = {YEAR} AND source = '{NODE}' AND target = '{OTHER}'")
def flow_value_G5(spark, sf_dir):
    return G.flow_value(edges_of(spark, sf_dir), NODE, OTHER)


@query(EDGES + f"SELECT target, value FROM edges WHERE year = {YEAR} AND source = '{NODE}' AND value >= 50000")
def outgoing_flows_G6(spark, sf_dir):
    return G.outgoing_flows(edges_of(spark, sf_dir), NODE, 50000).select("target", "value")


@query(EDGES + f"SELECT source, value FROM edges WHERE year = {YEAR} AND target = '{NODE}' AND value >= 50000")
def incoming_flows_G7(spark, sf_dir):
    return G.incoming_flows(edges_of(spark, sf_dir), NODE, 50000).select("source", "value")


@query(EDGES + f"SELECT target, value, row_number() OVER (ORDER BY value DESC, target)::INT AS rank FROM edges WHERE year = {YEAR} AND source = '{NODE}' QUALIFY rank <= 20")
def top_flows_T3(spark, sf_dir):
    return G.ranked(G.outgoing_flows(edges_of(spark, sf_dir), NODE)).select("target", "value", "rank")


@query(EDGES + f"SELECT greatest(count(*) - 20, 0) AS more FROM edges WHERE year = {YEAR} AND source = '{NODE}'")
def flows_not_shown_T3(spark, sf_dir):
    return G.not_shown(G.outgoing_flows(edges_of(spark, sf_dir), NODE))


@query(NODES + "SELECT DISTINCT country AS value FROM nodes")
def list_partitions_G11(spark, sf_dir):
    return G.distinct_values(nodes(spark, sf_dir), "country")


@query(NODES + "SELECT country AS value, row_number() OVER (ORDER BY country)::INT AS number FROM (SELECT DISTINCT country FROM nodes)")
def numbered_partitions_W4(spark, sf_dir):
    return G.numbered(G.distinct_values(nodes(spark, sf_dir), "country"))


@query(NODES + "SELECT count(*) AS vertices FROM nodes WHERE country = 'N09'")
def partition_count_A4(spark, sf_dir):
    return G.partition_count(nodes(spark, sf_dir), "country", "N09")


@query(NODES + "SELECT id FROM nodes WHERE id IN (SELECT DISTINCT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '_S' || (c_custkey % 7) FROM customer)")
def existing_ids_G10(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("_S"), (F.col("c_custkey") % 7).cast("string")).alias("id"))
    return G.existing_ids(nodes(spark, sf_dir), wanted)


@query(NODES + """SELECT country, count(*) AS n, string_agg(id, ',' ORDER BY id) AS nodes, string_agg(DISTINCT sector, ',' ORDER BY sector) AS sectors FROM nodes GROUP BY country""")
def nodes_by_country_P10(spark, sf_dir):
    return G.nodes_by_country(nodes(spark, sf_dir))


@query(NODES + f"""SELECT (SELECT count(*) > 0 FROM nodes WHERE id = '{NODE}') AS source_found, (SELECT count(*) > 0 FROM nodes WHERE id = '{OTHER}') AS target_found, (SELECT count(*) FROM nodes) AS vertices,
count(*) AS edges, min(value) FILTER (source = '{NODE}' AND target = '{OTHER}') AS flow, count(*) FILTER (source = '{NODE}' AND value >= 50000) AS n_out, round(sum(value) FILTER (source = '{NODE}' AND value >= 50000), 4) AS sum_out,
count(*) FILTER (target = '{OTHER}' AND value >= 50000) AS n_in, round(sum(value) FILTER (target = '{OTHER}' AND value >= 50000), 4) AS sum_in FROM edges WHERE year = {YEAR}""")
def query_report_G12(spark, sf_dir):
    return rounded(G.query_report(nodes(spark, sf_dir), edges_of(spark, sf_dir), NODE, OTHER, 50000), 4, "sum_out", "sum_in")


@query(EDGES + f"SELECT source, target, value FROM edges n WHERE year = {YEAR} AND NOT EXISTS (FROM edges o WHERE o.year = {YEAR - 1} AND o.source = n.source AND o.target = n.target)")
def insert_if_absent_S15(spark, sf_dir):
    new, old = edges_of(spark, sf_dir).drop("year"), edges_of(spark, sf_dir, YEAR - 1).drop("year")
    return maintenance.insert_if_absent(new, old, ["source", "target"])


@query(EDGES + f"SELECT source, target, arg_max(value, year) AS value FROM edges WHERE year IN ({YEAR - 1}, {YEAR}) GROUP BY ALL")
def upsert_D12(spark, sf_dir):
    new, old = edges_of(spark, sf_dir).drop("year"), edges_of(spark, sf_dir, YEAR - 1).drop("year")
    return maintenance.upsert(new, old, ["source", "target"])


@query(EDGES + f"SELECT year, source, target, value FROM edges WHERE year = {YEAR} AND source NOT LIKE 'N09%' AND target NOT LIKE 'N09%'")
def clear_partition_U8(spark, sf_dir):
    return maintenance.clear_partition(nodes(spark, sf_dir), edges_of(spark, sf_dir), "country", "N09")[1]


@query(NODES + "SELECT id, country FROM nodes WHERE country <> 'N09'")
def clear_partition_vertices_U8(spark, sf_dir):
    return maintenance.clear_partition(nodes(spark, sf_dir), edges_of(spark, sf_dir), "country", "N09")[0].select("id", "country")


NODE_ROWS = EDGES + """, s AS (SELECT year, source AS node, value AS o, NULL::DOUBLE AS i FROM edges UNION ALL SELECT year, target, NULL, value FROM edges),
a AS (SELECT year, node, sum(i) AS i, sum(o) AS o, count(i) AS ni, count(o) AS no FROM s GROUP BY ALL), y AS (SELECT DISTINCT year FROM edges),
f AS (SELECT a.year, a.node, coalesce(a.i, 0) AS in_strength, coalesce(a.o, 0) AS out_strength, a.ni AS in_degree, a.no AS out_degree,
  CASE WHEN a.year - 1 IN (FROM y) THEN coalesce((a.o - p.o) / nullif(p.o, 0), 0) END AS out_strength_growth, CASE WHEN a.year - 1 IN (FROM y) THEN coalesce((a.i - p.i) / nullif(p.i, 0), 0) END AS in_strength_growth,
  CASE WHEN a.year - 1 IN (FROM y) THEN coalesce(ln(1 + p.o), 0) END AS out_strength_lag1, CASE WHEN a.year - 1 IN (FROM y) THEN coalesce(ln(1 + p.i), 0) END AS in_strength_lag1
  FROM a LEFT JOIN a p ON p.node = a.node AND p.year = a.year - 1)
"""


@query(NODE_ROWS + "SELECT year, node, round(in_strength, 4) AS in_strength, round(out_strength, 4) AS out_strength, in_degree, out_degree, round(out_strength_growth, 8) AS out_strength_growth, round(in_strength_growth, 8) AS in_strength_growth, round(out_strength_lag1, 8) AS out_strength_lag1, round(in_strength_lag1, 8) AS in_strength_lag1 FROM f")
def node_features_N1(spark, sf_dir):
    return rounded(rounded(N.node_features(all_edges(spark, sf_dir)), 4, "in_strength", "out_strength"), 8, *N.NODE_LAG)


EDGE_ROWS = EDGES + """, y AS (SELECT DISTINCT year FROM edges),
ef AS (SELECT e.year, e.source, e.target, e.value, ln(1 + e.value) AS log_value_t, e.value / nullif(sum(e.value) OVER (PARTITION BY e.year, e.target), 0) AS share_target, e.value / nullif(sum(e.value) OVER (PARTITION BY e.year, e.source), 0) AS share_source,
  CASE WHEN e.year - 1 IN (FROM y) THEN coalesce((e.value - p.value) / nullif(p.value, 0), 0) END AS edge_growth, CASE WHEN e.year - 1 IN (FROM y) THEN ln(1 + coalesce(p.value, 0)) END AS log_value_lag1
  FROM edges e LEFT JOIN edges p ON p.year = e.year - 1 AND p.source = e.source AND p.target = e.target)
"""


@query(EDGE_ROWS + "SELECT year, source, target, value, round(log_value_t, 8) AS log_value_t, round(share_target, 8) AS share_target, round(share_source, 8) AS share_source, round(edge_growth, 8) AS edge_growth, round(log_value_lag1, 8) AS log_value_lag1 FROM ef")
def edge_features_N2(spark, sf_dir):
    return rounded(N.edge_features(all_edges(spark, sf_dir)), 8, *N.EDGE_BASE, *N.EDGE_LAG)


@query(EDGES + "SELECT year, source, target, round(value / sum(value) OVER (PARTITION BY year, target), 8) AS share_target FROM edges")
def share_within_target_W2(spark, sf_dir):
    return rounded(N.edge_features(all_edges(spark, sf_dir)).select("year", "source", "target", "share_target"), 8, "share_target")


LABELS = EDGES + """, y AS (SELECT DISTINCT year FROM edges), ly AS (SELECT year FROM y WHERE year + 1 IN (FROM y)),
pairs AS (SELECT ly.year, e.source, e.target FROM ly JOIN edges e ON e.year IN (ly.year, ly.year - 1) GROUP BY ALL),
w AS (SELECT k.year, k.source, k.target, coalesce(p.value, 0) AS p, coalesce(t.value, 0) AS t, coalesce(n.value, 0) AS n FROM pairs k
  LEFT JOIN edges p ON p.year = k.year - 1 AND p.source = k.source AND p.target = k.target LEFT JOIN edges t ON t.year = k.year AND t.source = k.source AND t.target = k.target LEFT JOIN edges n ON n.year = k.year + 1 AND n.source = k.source AND n.target = k.target),
labels AS (SELECT year, source, target, t AS value_t, n AS value_t1, CASE WHEN p > 0 AND t > 0 THEN (n - t) / t ELSE 0 END AS pct_change, p > 0 AND t > 0 AS is_established, NOT p > 0 AND t > 0 AS is_new_edge,
  (p > 0 AND t > 0 AND (n - t) / nullif(t, 0) < -0.1)::INT AS y_drop, (p > 0 AND t > 0 AND n = 0)::INT AS y_disappear FROM w)
"""


@query(LABELS + "SELECT year, source, target, value_t, value_t1, round(pct_change, 8) AS pct_change, y_drop, y_disappear, is_new_edge, is_established FROM labels")
def drop_labels_N3(spark, sf_dir):
    return rounded(N.label_trade_drops(all_edges(spark, sf_dir)), 8, "pct_change")


@query(LABELS + "SELECT year, source, target, value_t, value_t1 FROM labels WHERE abs(ln(1 + value_t1) - ln(1 + value_t)) <= 1")
def clean_drop_N4(spark, sf_dir):
    return N.clean_edge_values(N.label_trade_drops(all_edges(spark, sf_dir)), 1.0).select("year", "source", "target", "value_t", "value_t1")


@query(LABELS + "SELECT year, source, target, round(CASE WHEN abs(d) <= 1 THEN value_t1 ELSE exp(ln(1 + value_t) + greatest(-1, least(1, d))) - 1 END, 4) AS value_t1, abs(d) <= 1 AS valid FROM (SELECT *, ln(1 + value_t1) - ln(1 + value_t) AS d FROM labels)")
def clean_cap_N4(spark, sf_dir):
    return rounded(N.clean_edge_values(N.label_trade_drops(all_edges(spark, sf_dir)), 1.0, "cap").select("year", "source", "target", "value_t1", "valid"), 4, "value_t1")


@query(LABELS + "SELECT year, source, target, y_drop FROM labels WHERE abs(pct_change) >= 0.25")
def small_changes_FL10(spark, sf_dir):
    return N.significant(N.label_trade_drops(all_edges(spark, sf_dir)), 0.25).select("year", "source", "target", "y_drop")


@query(LABELS + "SELECT year, count(*) AS edges, sum(y_drop)::BIGINT AS drops, round(min(d), 8) AS least, round(max(d), 8) AS greatest, round(stddev_samp(d), 8) AS deviation FROM (SELECT *, ln(1 + value_t1) - ln(1 + value_t) AS d FROM labels) GROUP BY year")
def change_statistics_A29(spark, sf_dir):
    return rounded(N.change_statistics(N.label_trade_drops(all_edges(spark, sf_dir))), 8, "least", "greatest", "deviation")


@query(EDGES + "SELECT year, source, target, round(coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0), 6) AS z FROM (SELECT year, source, target, ln(1 + value) AS v FROM edges) WINDOW w AS (PARTITION BY year)")
def standardize_N5(spark, sf_dir):
    return rounded(N.standardize(all_edges(spark, sf_dir).select("year", "source", "target", F.log1p("value").alias("z")), ["z"]), 6, "z")


@query(NODES + "SELECT id AS node, (row_number() OVER (ORDER BY id) - 1)::INT AS idx FROM nodes")
def node_index_W6(spark, sf_dir):
    return N.node_index(E.endpoints(all_edges(spark, sf_dir)))


def z(c: str) -> str:
    return f"round(coalesce(({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0), 0), 6) AS {c}"


MATRIX = NODE_ROWS + ", ids AS (SELECT node, (row_number() OVER (ORDER BY node) - 1)::INT AS idx FROM (SELECT DISTINCT node FROM s WHERE year = 1995)), g AS (SELECT y.year, ids.idx, ids.node, " + ", ".join(f"coalesce(f.{c}, 0)::DOUBLE AS {c}" for c in (*N.NODE_BASE, *N.NODE_LAG)) + " FROM y CROSS JOIN ids LEFT JOIN f ON f.year = y.year AND f.node = ids.node)"


@query(MATRIX + "SELECT year, idx, node, " + ", ".join(map(z, (*N.NODE_BASE, *N.NODE_LAG))) + " FROM g WINDOW w AS (PARTITION BY year)")
def node_matrix_N9(spark, sf_dir):
    rows = all_edges(spark, sf_dir)
    index = N.node_index(E.endpoints(rows.where("year = 1995")))
    names = [*N.NODE_BASE, *N.NODE_LAG]
    return rounded(N.node_matrix(N.node_features(rows), index, names), 6, *names)


@query(
    LABELS.rstrip() + EDGE_ROWS[len(EDGES) :].replace(", y AS (SELECT DISTINCT year FROM edges),\n", ",\n", 1).rstrip()
    + """, ids AS (SELECT id, (row_number() OVER (ORDER BY id) - 1)::INT AS idx FROM (SELECT source AS id FROM edges WHERE year = 1995 UNION SELECT target FROM edges WHERE year = 1995)),
k AS (SELECT ef.*, l.y_drop, l.value_t1, a.idx AS src_idx, b.idx AS tgt_idx FROM ef JOIN labels l ON l.year = ef.year AND l.source = ef.source AND l.target = ef.target JOIN ids a ON a.id = ef.source JOIN ids b ON b.id = ef.target WHERE abs(ln(1 + l.value_t1) - ln(1 + l.value_t)) <= 3)
SELECT year, src_idx, tgt_idx, source, target, y_drop AS y, value_t1, """ + ", ".join(map(z, (*N.EDGE_BASE, *N.EDGE_LAG))) + " FROM k WINDOW w AS (PARTITION BY year)"
)
def graph_assembly_N6(spark, sf_dir):
    rows = N.build_graph(all_edges(spark, sf_dir), 1995)[1]
    features = {c: F.round(F.get("features", F.lit(i)), 6) for i, c in enumerate((*N.EDGE_BASE, *N.EDGE_LAG))}
    return rows.withColumns(features).drop("features", "value_t")


@query(
    MATRIX.replace("FROM y CROSS JOIN ids", "FROM (SELECT year FROM y WHERE year + 1 IN (FROM y)) y CROSS JOIN ids")
    + " SELECT year, idx, node, (year - 1995) / 20.0::DOUBLE AS year_code, " + ", ".join(map(z, (*N.NODE_BASE, *N.NODE_LAG))) + " FROM g WINDOW w AS (PARTITION BY year)"
)
def graph_nodes_N8(spark, sf_dir):
    rows = N.build_graph(all_edges(spark, sf_dir), 1995)[0]
    names = (*N.NODE_BASE, *N.NODE_LAG)
    return rows.withColumns({c: F.round(F.get("features", F.lit(i)), 6) for i, c in enumerate(names)}).withColumn("year_code", F.get("features", F.lit(len(names)))).drop("features")


LEVELS = """, e AS (SELECT source, target, value FROM edges WHERE year = %d%s),
l0 AS (SELECT unnest(%s) AS node), l1 AS (SELECT DISTINCT target AS node FROM e WHERE source IN (FROM l0) AND target NOT IN (FROM l0)), l2 AS (SELECT DISTINCT target AS node FROM e WHERE source IN (FROM l1) AND target NOT IN (FROM l0) AND target NOT IN (FROM l1)),
lv AS (SELECT node, 0 AS hops FROM l0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2)
"""



def cascade_sql(floor: str = "") -> str:
    return EDGES + LEVELS % (YEAR, floor, f"['{NODE}']") + ", c AS (SELECT (hops + 1)::INT AS degree, source, target, value AS original_value, value * 0.8 AS new_value, value - value * 0.8 AS reduction, 0.2::DOUBLE AS reduction_pct FROM e JOIN lv ON lv.node = e.source)"


FLOWS = "SELECT degree, source, target, original_value, round(new_value, 4) AS new_value, round(reduction, 4) AS reduction, reduction_pct FROM c"


def cascade(spark, sf_dir, least: float = 0.0) -> DataFrame:
    return traversal.simulate_disruption(edges_of(spark, sf_dir), NODE, 0.2, 3, least)


@query(cascade_sql() + FLOWS)
def cascade_G8(spark, sf_dir):
    return rounded(cascade(spark, sf_dir), 4, "new_value", "reduction")


@query(cascade_sql(f" AND value >= {LARGE}") + FLOWS)
def cascade_least_flow_G8(spark, sf_dir):
    """The same with a least flow, the parameter that prunes a cascade."""
    return rounded(cascade(spark, sf_dir, LARGE), 4, "new_value", "reduction")


@query(cascade_sql() + "SELECT count(*) AS total_flows, round(sum(original_value), 4) AS total_original_value, round(sum(new_value), 4) AS total_new_value, round(sum(original_value) - sum(new_value), 4) AS total_reduction, round((sum(original_value) - sum(new_value)) / sum(original_value) * 100, 6) AS overall_reduction_pct FROM c")
def cascade_summary_A21(spark, sf_dir):
    out = traversal.cascade_summary(cascade(spark, sf_dir))
    return rounded(rounded(out, 4, "total_original_value", "total_new_value", "total_reduction"), 6, "overall_reduction_pct")


@query(EDGES + LEVELS % (YEAR, "", f"['{NODE}', '{OTHER}']") + "SELECT source, target, value, least(3, coalesce(hops, 3))::INT AS distance FROM e LEFT JOIN lv ON lv.node = e.source")
def edge_distance_M9(spark, sf_dir):
    return traversal.edge_distance(edges_of(spark, sf_dir).drop("year"), spark.createDataFrame([(NODE,), (OTHER,)], "node string"))


@query(EDGES + f"SELECT DISTINCT target AS id FROM edges WHERE year = {YEAR} AND source IN ('{NODE}', '{OTHER}')")
def downstream_flag_J15(spark, sf_dir):
    return traversal.downstream(edges_of(spark, sf_dir), spark.createDataFrame([(NODE,), (OTHER,)], "id string"))
