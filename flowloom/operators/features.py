"""Yearly node and edge features, labels of trade drops, cleaning, scaling and indexing.

All years are in one table and one plan: a year meets the one before by a join on year - 1. "No year before" means
that the whole year is absent; its lag columns are NULL then, while single missing edges count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalar import clip, growth, log_change, year_code
from flowloom.operators.quantiles import exact_median
from flowloom.shared import written

NODE_BASE = ("in_strength", "out_strength", "in_degree", "out_degree")
NODE_LAG = ("out_strength_growth", "in_strength_growth", "out_strength_lag1", "in_strength_lag1")
EDGE_BASE = ("log_value_t", "share_target", "share_source")
EDGE_LAG = ("edge_growth", "log_value_lag1")


def node_strengths(edges: DataFrame) -> DataFrame:
    """year, node, in and out strength and degree. Both ends go through one aggregation; a side without edges is NULL in raw_* and 0 in the features."""
    ends = edges.select("year", F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("value").alias("out"), F.lit(None).cast("double").alias("in")), F.struct(F.col("target").alias("node"), F.lit(None).cast("double").alias("out"), F.col("value").alias("in")))).alias("e"))
    sums = ends.select("year", "e.*").groupBy("year", "node").agg(F.sum("in").alias("raw_in"), F.sum("out").alias("raw_out"), F.count("in").alias("in_degree"), F.count("out").alias("out_degree"))
    return sums.select("year", "node", F.coalesce("raw_in", F.lit(0.0)).alias("in_strength"), F.coalesce("raw_out", F.lit(0.0)).alias("out_strength"), "in_degree", "out_degree", "raw_in", "raw_out")


def years_with_predecessor(edges: DataFrame) -> DataFrame:
    """year of each year of which the year before is there too; a few rows."""
    years = edges.select("year").distinct()
    return years.join(years.select((F.col("year") + 1).alias("year")), "year", "left_semi").withColumn("has_prev", F.lit(True))


def node_features(edges: DataFrame, indicators: DataFrame | None = None, node_col: str = "node") -> DataFrame:
    """year, node, NODE_BASE, NODE_LAG and the columns of indicators(year, node, ...), whose gaps get the year's median, then 0.

    A node that lost all its flow on a side has growth 0 there: the side's own sum is missing, not 0.
    """
    now = node_strengths(edges)
    before = now.select((F.col("year") + 1).alias("year"), "node", F.col("raw_in").alias("p_in"), F.col("raw_out").alias("p_out"))
    rows = now.join(before, ["year", "node"], "left").join(F.broadcast(years_with_predecessor(edges)), "year", "left")

    def lag(value: Column) -> Column:
        return F.when(F.col("has_prev"), value)

    out = rows.select(
        "year", "node", *NODE_BASE,
        lag(growth(F.col("raw_out"), F.col("p_out"))).alias("out_strength_growth"), lag(growth(F.col("raw_in"), F.col("p_in"))).alias("in_strength_growth"),
        lag(F.coalesce(F.log1p("p_out"), F.lit(0.0))).alias("out_strength_lag1"), lag(F.coalesce(F.log1p("p_in"), F.lit(0.0))).alias("in_strength_lag1"),
    )
    if indicators is None:
        return out
    names = [c for c in indicators.columns if c not in ("year", node_col)]
    out = out.join(indicators.withColumnRenamed(node_col, "node"), ["year", "node"], "left")
    return median_filled(out, names)


def median_filled(rows: DataFrame, names: list[str], partition: str = "year") -> DataFrame:
    """Gaps get the exact median over the partition's rows, then 0. No task holds a partition's values."""
    rows = out = written(rows, "gaps")  # read again for each column
    for c in names:
        out = out.join(F.broadcast(exact_median(rows, [partition], c, f"median_{c}")), partition, "left")  # a row for each partition
    return out.withColumns({c: F.coalesce(c, f"median_{c}", F.lit(0.0)) for c in names}).drop(*[f"median_{c}" for c in names])


def edge_features(edges: DataFrame) -> DataFrame:
    """year, source, target, value, EDGE_BASE and EDGE_LAG."""
    into = edges.groupBy("year", "target").agg(F.sum("value").alias("sum_in"))
    out_of = edges.groupBy("year", "source").agg(F.sum("value").alias("sum_out"))
    before = edges.select((F.col("year") + 1).alias("year"), "source", "target", F.col("value").alias("prev"))
    rows = edges.select("year", "source", "target", "value").join(into, ["year", "target"]).join(out_of, ["year", "source"]).join(before, ["year", "source", "target"], "left").join(F.broadcast(years_with_predecessor(edges)), "year", "left")
    prev = F.coalesce("prev", F.lit(0.0))
    return rows.select(
        "year", "source", "target", "value", F.log1p("value").alias("log_value_t"),
        F.coalesce(F.try_divide("value", "sum_in"), F.lit(0.0)).alias("share_target"), F.coalesce(F.try_divide("value", "sum_out"), F.lit(0.0)).alias("share_source"),
        F.when(F.col("has_prev"), growth(F.col("value"), prev)).alias("edge_growth"), F.when(F.col("has_prev"), F.log1p(prev)).alias("log_value_lag1"),
    )


def label_trade_drops(edges: DataFrame, threshold: float = 0.1) -> DataFrame:
    """year, source, target, value_t, value_t1, pct_change, y_drop, y_disappear, is_new_edge, is_established for each year and pair of that year or the one before.

    One aggregation: each edge is dealt to the year itself, the one after and the one before. Years without edges, or
    without a year after them, have no labels; in a year without a year before nothing is established, so all are 0.
    """
    years = edges.select("year").distinct()
    years = years.join(years.select((F.col("year") - 1).alias("year")), "year", "left_semi")
    dealt = edges.select("source", "target", "value", F.explode(F.array(*[F.struct((F.col("year") + k).alias("year"), F.lit(k).alias("k")) for k in (-1, 0, 1)])).alias("d"))
    at = lambda k: F.sum(F.when(F.col("k") == k, F.col("value")))
    sums = dealt.select("source", "target", "value", "d.*").groupBy("year", "source", "target").agg(at(1).alias("p"), at(0).alias("t"), at(-1).alias("n"))
    rows = sums.where("p IS NOT NULL OR t IS NOT NULL").join(F.broadcast(years), "year", "left_semi")
    p, t, n = (F.coalesce(c, F.lit(0.0)) for c in "ptn")
    held = (p > 0) & (t > 0)
    change = F.when(held, F.try_divide(n - t, t)).otherwise(0.0)
    return rows.select(
        "year", "source", "target", t.alias("value_t"), n.alias("value_t1"), change.alias("pct_change"), (held & (change < -threshold)).cast("int").alias("y_drop"),
        (held & (n == 0)).cast("int").alias("y_disappear"), (~(p > 0) & (t > 0)).alias("is_new_edge"), held.alias("is_established"),
    )


def clean_edge_values(rows: DataFrame, max_log_change: float = 3.0, mode: str = "drop") -> DataFrame:
    """Rows whose log change is beyond the limit are dropped, or capped (mode cap) with a column `valid`."""
    if mode not in ("drop", "cap"):
        raise ValueError("mode is drop or cap")
    change = log_change(F.col("value_t"), F.col("value_t1"))
    inside = F.abs(change) <= max_log_change
    if mode == "drop":
        return rows.where(inside) if max_log_change > 0 else rows
    capped = F.expm1(F.log1p("value_t") + clip(change, -max_log_change, max_log_change))
    return rows.withColumns({"value_t1": F.when(inside, F.col("value_t1")).otherwise(capped), "valid": inside})


def significant(rows: DataFrame, min_change: float) -> DataFrame:
    """Rows whose pct_change is at least min_change either way. New edges have 0 and go, and with them a first year."""
    return rows.where(F.abs(F.coalesce("pct_change", F.lit(0.0))) >= min_change) if min_change > 0 else rows


def standardize(rows: DataFrame, columns: list[str], partition: str = "year") -> DataFrame:
    """Each column less its mean by its population deviation within the partition; 0 where that is 0 or missing; gaps stay.

    Means come from an aggregation that is joined back, a row for each partition, so a large year is not one task's.
    """
    stats = rows.groupBy(partition).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("dev", F.stddev_pop))])
    scaled = {c: F.when(F.coalesce(f"dev_{c}", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"dev_{c}"))) for c in columns}
    return rows.join(F.broadcast(stats), partition).withColumns(scaled).drop(*stats.columns[1:])


def node_index(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """node, idx from 0 by name, without gaps. Ranges of names are numbered each by itself; what lies in the ranges before is added, one number for each."""
    names = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    parts = parts or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(names.repartitionByRange(parts, "node").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = {r["part"]: r["count"] for r in held.groupBy("part").count().collect()}
    before = [sum(n for p, n in sizes.items() if p < k) for k in range(parts)]
    place = F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1
    return held.select("node", (place + F.element_at(F.lit(before), F.col("part") + 1)).cast("int").alias("idx"))


def numeric_features(rows: DataFrame, exclude: tuple[str, ...] = ("year", "source", "target", "node", "value", "value_t", "value_t1", "pct_change", "y_drop", "src_idx", "tgt_idx")) -> list[str]:
    return [c for c, kind in rows.dtypes if kind in ("double", "float", "bigint", "int") and c not in exclude]


def node_matrix(features: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """year, idx, node and the columns for each year and indexed node: gaps are 0, then scaled over all indexed nodes."""
    years = [r.year for r in features.select("year").distinct().collect()]
    grid = index.withColumn("year", F.explode(F.array(*[F.lit(y) for y in sorted(years)]).cast("array<int>")))
    rows = grid.join(features.select("year", "node", *columns), ["year", "node"], "left").select("year", "idx", "node", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return standardize(rows, columns)


def build_graph(edges: DataFrame, first_year: int, threshold: float = 0.1, max_log_change: float = 3.0, min_change: float = 0.0, indicators: DataFrame | None = None, start_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph_nodes, graph_edges) of all years that have a year after them.

    Strengths and shares come from all edges, scaling from those that are left after cleaning; the node universe is that
    of first_year; the year's code joins the node features after scaling.
    """
    edges = written(edges.select("year", "source", "target", "value"), "edges")  # used about ten times below
    index = node_index(edges.where(F.col("year") == first_year).select(F.explode(F.array("source", "target"))))
    labelled = edges.select("year").distinct().join(edges.select((F.col("year") - 1).alias("year")).distinct(), "year", "left_semi")
    rows = edge_features(edges).join(F.broadcast(labelled), "year", "left_semi").join(label_trade_drops(edges, threshold).select("year", "source", "target", "value_t", "value_t1", "pct_change", "y_drop"), ["year", "source", "target"], "left")
    rows = significant(clean_edge_values(rows, max_log_change), min_change)
    rows = rows.join(index.select(F.col("node").alias("source"), F.col("idx").alias("src_idx")), "source").join(index.select(F.col("node").alias("target"), F.col("idx").alias("tgt_idx")), "target")
    names = [*EDGE_BASE, *EDGE_LAG]
    scaled = standardize(rows, names)
    graph_edges = scaled.select("year", "src_idx", "tgt_idx", "source", "target", F.array(*[F.coalesce(c, F.lit(0.0)) for c in names]).alias("features"), F.col("y_drop").alias("y"), "value_t", "value_t1")
    features = node_features(edges, indicators).join(F.broadcast(labelled), "year", "left_semi")
    columns = [*NODE_BASE, *NODE_LAG, *([c for c in indicators.columns if c not in ("year", "node")] if indicators is not None else [])]
    matrix = node_matrix(features, index, columns)
    code = year_code(F.col("year"), start_year if start_year is not None else first_year)
    return matrix.select("year", "idx", "node", F.array(*columns, code).alias("features")), graph_edges


def change_statistics(rows: DataFrame) -> DataFrame:
    """One row for each year: edges, drops, least, greatest and sample deviation of the log change."""
    change = log_change(F.col("value_t"), F.col("value_t1"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("edges"), F.sum("y_drop").alias("drops"), F.min(change).alias("least"), F.max(change).alias("greatest"), F.stddev_samp(change).alias("deviation"))
