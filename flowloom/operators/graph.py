"""Point and neighbour queries on edge and node tables. What isn't there gives no row or NULL, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalar import country, sector
from flowloom.operators.shocks import seeded


def node_exists(nodes: DataFrame, node: str) -> DataFrame:
    """One row: found."""
    return nodes.where(F.col("id") == node).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def node_properties(nodes: DataFrame, node: str) -> DataFrame:
    """id and a map from each property to the list of its values."""
    names = [c for c in nodes.columns if c != "id"]
    pairs = [x for c in names for x in (F.lit(c), F.array(F.col(c).cast("string")))]
    return nodes.where(F.col("id") == node).select("id", F.create_map(*pairs).alias("properties"))


def random_node(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """One node drawn evenly: the least of a seeded hash, so the same each time, and one pass without a sort."""
    return nodes.select("id").orderBy(seeded(seed, ["id"]), "id").limit(1)


def first_edge(edges: DataFrame) -> DataFrame:
    """One edge, the first by its ends."""
    return edges.orderBy("source", "target").limit(1)


def flow_value(edges: DataFrame, source: str, target: str) -> DataFrame:
    """One row: the flow from source to target, NULL if there is none."""
    return edges.where((F.col("source") == source) & (F.col("target") == target)).agg(F.min("value").alias("value"))


def outgoing_flows(edges: DataFrame, node: str, min_value: float = 0.0, n: int | None = None) -> DataFrame:
    """Flows out of node of at least min_value, largest first; with n the first n of them."""
    out = edges.where((F.col("source") == node) & (F.col("value") >= min_value)).orderBy(F.desc("value"), "target")
    return out.limit(n) if n is not None else out


def incoming_flows(edges: DataFrame, node: str, min_value: float = 0.0, n: int | None = None) -> DataFrame:
    out = edges.where((F.col("target") == node) & (F.col("value") >= min_value)).orderBy(F.desc("value"), "source")
    return out.limit(n) if n is not None else out


def ranked(flows: DataFrame, by: str = "value", tie: str = "target", n: int = 20) -> DataFrame:
    """The n largest with their rank. Only n rows meet in one task."""
    top = flows.orderBy(F.desc(by), tie).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), tie)))


def not_shown(flows: DataFrame, n: int = 20) -> DataFrame:
    """One row: how many flows there are beyond the n that ranked() shows."""
    return flows.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges."""
    both = nodes.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("vertices"), F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("edges"))


def existing_ids(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the wanted ids that nodes has."""
    return wanted.select("id").distinct().join(nodes.select("id"), "id", "left_semi")


def distinct_values(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.select(F.col(key).alias("value")).distinct().orderBy("value")


def numbered(values: DataFrame) -> DataFrame:
    """value and its place from 1 by name: for a listing, whose values are few."""
    return values.withColumn("number", F.row_number().over(Window.orderBy("value")))


def partition_count(nodes: DataFrame, key: str, value: str) -> DataFrame:
    return nodes.where(F.col(key) == value).agg(F.count(F.lit(1)).alias("vertices"))


def nodes_by_country(nodes: DataFrame) -> DataFrame:
    """country, n and its sorted nodes with their sectors (N/A without an underscore)."""
    own = F.when(F.contains(F.col("id"), F.lit("_")), sector(F.col("id"))).otherwise("N/A")
    return nodes.groupBy(country(F.col("id")).alias("country")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("nodes"), F.array_join(F.sort_array(F.collect_set(own)), ",").alias("sectors"))


def query_report(nodes: DataFrame, edges: DataFrame, source: str, target: str, min_value: float = 0.0) -> DataFrame:
    """One row: both ends found, the flow between them, counts and sums of the flows out of source and into target, sizes. One pass over each table."""
    none = F.lit(None).cast("string")
    rows = nodes.select("id", none.alias("source"), none.alias("target"), F.lit(None).cast("double").alias("value")).unionAll(edges.select(none, "source", "target", F.col("value").cast("double")))
    out, into, big = F.col("source") == source, F.col("target") == target, F.col("value") >= min_value
    return rows.agg(
        (F.count_if(F.col("id") == source) > 0).alias("source_found"), (F.count_if(F.col("id") == target) > 0).alias("target_found"), F.count("id").alias("vertices"), F.count("source").alias("edges"),
        F.min(F.when(out & into, F.col("value"))).alias("flow"), F.count_if(out & big).alias("n_out"), F.sum(F.when(out & big, F.col("value"))).alias("sum_out"), F.count_if(into & big).alias("n_in"), F.sum(F.when(into & big, F.col("value"))).alias("sum_in"),
    )
