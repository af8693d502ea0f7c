"""Bounded breadth-first search over edges, disruption cascades and distances.

A hop joins the frontier with the edges and keeps nodes that were not reached before; each frontier is written to the
shared folder, so a hop never works out the ones before it again. Searches from many starts run together, told apart
by key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.shared import written


def hops(edges: DataFrame, starts: DataFrame, rounds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, hops for all nodes at most `rounds` hops from starts(keys, node). Key columns that edges has too must agree."""
    own = [k for k in keys if k in edges.columns]
    links = edges.select(*own, F.col("source").alias("node"), F.col("target").alias("next")).distinct()
    if rounds > 1:
        links = written(links, "links")  # else each hop works them out again
    seen = frontier = starts.select(*keys, "node").distinct().withColumn("hops", F.lit(0))
    for n in range(1, rounds + 1):
        step = frontier.select(*keys, "node").join(links, [*own, "node"]).select(*keys, F.col("next").alias("node")).distinct()
        frontier = written(step.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("hops", F.lit(n)), "frontier")
        seen = seen.unionByName(frontier)
        if n < rounds and not frontier.limit(1).count():
            break
    return seen


WORD = 64


def reach(edges: DataFrame, starts: DataFrame, rounds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, word, hop0 ... hop{rounds}: for each node the trials that first reach it after so many hops, as bits of a number.

    starts: keys, node and trial (from 0). 64 trials share a word, and with it each row of a frontier and each join:
    a hop is a bitwise or over the suppliers, less the bits that the node has. keys are columns of edges too.
    """
    at = [*keys, "word", "node"]
    links = written(edges.select(*keys, F.col("source").alias("node"), F.col("target").alias("next")).distinct(), "links")
    bits = F.bit_or(F.expr(f"shiftleft(1L, cast(trial % {WORD} AS INT))"))
    frontier = starts.groupBy(*keys, F.floor(F.col("trial") / WORD).cast("int").alias("word"), "node").agg(bits.alias("bits"))
    seen = frontier = written(frontier.withColumn("hop", F.lit(0)), "frontier")
    for n in range(1, rounds + 1):
        step = frontier.join(links, [*keys, "node"]).groupBy(*keys, "word", F.col("next").alias("node")).agg(F.bit_or("bits").alias("bits"))
        held = seen.groupBy(*at).agg(F.bit_or("bits").alias("held"))
        fresh = step.join(held, at, "left").select(*at, F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("bigint")))).alias("bits"))
        frontier = written(fresh.where("bits <> 0").withColumn("hop", F.lit(n)), "frontier")
        seen = seen.unionByName(frontier)
    none = F.lit(0).cast("bigint")
    return seen.groupBy(*at).agg(*[F.coalesce(F.bit_or(F.when(F.col("hop") == n, F.col("bits"))), none).alias(f"hop{n}") for n in range(rounds + 1)])


def with_distances(edges: DataFrame, level: DataFrame, trials: int, cap: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """edges with trial (from 0) and distance, a row for each trial: hops from the trial's starts to the edge's source, at most cap, which also stands for unreached. level: what reach() gives, node named source."""
    words = edges.withColumn("word", F.explode(F.sequence(F.lit(0), F.lit((trials - 1) // WORD))))
    last = F.least(F.col("word") * WORD + WORD, F.lit(trials)) - 1
    rows = words.join(level, [*keys, "word", "source"], "left").withColumn("trial", F.explode(F.sequence(F.col("word") * WORD, last)))
    distance = F.lit(cap)
    for n in reversed(range(cap)):
        has = F.expr(f"(shiftrightunsigned(hop{n}, cast(trial % {WORD} AS INT)) & 1) = 1")
        distance = F.when(has, n).otherwise(distance)
    return rows.withColumn("distance", distance).drop("word", *[f"hop{n}" for n in range(cap)])


def trial_distances(edges: DataFrame, starts: DataFrame, trials: int, cap: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """with_distances() by the edges' own links. starts: keys, node and trial (from 0)."""
    return with_distances(edges, reach(edges, starts, cap - 1, keys).withColumnRenamed("node", "source"), trials, cap, keys)


def simulate_disruption(edges: DataFrame, node: str, reduction: float, max_degrees: int = 3, min_flow: float = 0.0) -> DataFrame:
    """degree, source, target, original_value, new_value, reduction, reduction_pct of all flows that a cut at node reaches.

    A flow's degree is the hops from node to its source and one; every flow loses the same share.
    """
    flows = edges.where(F.col("value") >= min_flow)
    start = edges.sparkSession.createDataFrame([(node,)], "node string")
    level = hops(flows, start, max_degrees - 1)
    new = F.col("value") * (1 - reduction)
    return flows.join(level.select(F.col("node").alias("source"), "hops"), "source").select(
        (F.col("hops") + 1).alias("degree"), "source", "target", F.col("value").alias("original_value"), new.alias("new_value"), (F.col("value") - new).alias("reduction"), F.lit(float(reduction)).alias("reduction_pct")
    )


def cascade_summary(flows: DataFrame) -> DataFrame:
    """One row: totals and the overall loss in percent; NULL where nothing flows."""
    total, new = F.sum("original_value"), F.sum("new_value")
    return flows.agg(F.count(F.lit(1)).alias("total_flows"), total.alias("total_original_value"), new.alias("total_new_value"), (total - new).alias("total_reduction"), F.try_divide(total - new, total).alias("share")).select(
        "total_flows", "total_original_value", "total_new_value", "total_reduction", (F.col("share") * 100).alias("overall_reduction_pct")
    )


def cascade_nested(flows: DataFrame) -> DataFrame:
    """One row for each degree with the list of its flows, largest first: for a report on one node, as a degree's flows are one row."""
    one = F.struct((-F.col("original_value")).alias("order"), "source", "target", "original_value", "new_value", "reduction", "reduction_pct")
    return flows.groupBy("degree").agg(F.array_sort(F.collect_list(one)).alias("flows"))


def edge_distance(edges: DataFrame, shocked: DataFrame, cap: int = 3, keys: tuple[str, ...] = (), trials: int = 0) -> DataFrame:
    """edges and distance: hops from the shocked nodes to the edge's source, at most cap, which also stands for unreached.

    shocked: keys and node (or id). With trials, shocked has a key `trial` from 1 to trials, and each edge gives a row for each trial.
    """
    level = hops(edges, shocked.withColumnRenamed("id", "node"), cap - 1, keys)
    if trials:
        edges = edges.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    return edges.join(level.withColumnRenamed("node", "source"), [*keys, "source"], "left").withColumn("distance", F.least(F.lit(cap), F.coalesce("hops", F.lit(cap)))).drop("hops")


def downstream(edges: DataFrame, shocked: DataFrame) -> DataFrame:
    """id of each node that a shocked node supplies."""
    return edges.join(shocked.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
