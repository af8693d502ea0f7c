"""Counterfactual runs: predictions with and without a shock, what they mean in values, and roll-ups of the differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalar import country, relative_change, sector_token
from flowloom.operators.quantiles import exact_median

#: Mean shock of the training data, by which effects are scaled. Fixed value.
TYPICAL = -0.175


def valid_shocks(nodes: DataFrame, wanted: list[str]) -> DataFrame:
    """id of the wanted nodes that there are; an error if there are none. Others are left out."""
    ids = nodes.where(F.col("id").isin(wanted)).select("id").distinct()
    if not ids.limit(1).count():
        raise ValueError("none of the shocked nodes is in the graph")
    return ids


def edge_type(source_hit: Column, target_hit: Column) -> Column:
    return F.when(source_hit & target_hit, "internal").when(target_hit, "direct_incoming").when(source_hit, "direct_outgoing").otherwise("indirect")


def simulate_shock(rows: DataFrame, shocked: list[str], magnitude: float = 0.5, typical: float = TYPICAL) -> DataFrame:
    """rows(source, target, value_t, baseline_delta, shocked_delta) with effects scaled to the magnitude (always a loss), values, changes and edge types."""
    effect = (F.col("shocked_delta") - F.col("baseline_delta")) * (-abs(magnitude) / typical)
    base = F.expm1(F.log1p("value_t") + F.col("baseline_delta"))
    after = F.expm1(F.log1p("value_t") + F.col("baseline_delta") + effect)
    out = rows.select(
        "source", "target", country(F.col("source")).alias("source_country"), country(F.col("target")).alias("target_country"), sector_token(F.col("source")).alias("source_sector"), sector_token(F.col("target")).alias("target_sector"),
        "value_t", base.alias("baseline_value_t1"), after.alias("shocked_value_t1"), effect.alias("effect_log"),
    )
    change = F.col("shocked_value_t1") - F.col("baseline_value_t1")
    kind = edge_type(F.col("source").isin(shocked), F.col("target").isin(shocked))
    return out.withColumns({"absolute_change": change, "pct_change": relative_change(F.col("baseline_value_t1"), F.col("shocked_value_t1")) * 100, "edge_type": kind, "abs_change": F.abs(change)})


def strongest(result: DataFrame, n: int | None = None) -> DataFrame:
    """By absolute change, largest first; with n the first n."""
    out = result.orderBy(F.desc("abs_change"), "source", "target")
    return out.limit(n) if n is not None else out


def impact_by(result: DataFrame, key: str, n: int = 10) -> DataFrame:
    """key, total change, mean percentage and value for each group; the n with the largest total either way."""
    sums = result.groupBy(key).agg(F.sum("absolute_change").alias("total_change"), F.avg("pct_change").alias("mean_pct"), F.sum("value_t").alias("value_t"))
    return sums.orderBy(F.desc(F.abs("total_change")), key).limit(n)


def impacts(result: DataFrame) -> DataFrame:
    """All three roll-ups (target country, sector and node) from one pass: level, key, total_change, mean_pct, value_t."""
    each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(c).alias("key")) for level, c in (("country", "target_country"), ("sector", "target_sector"), ("node", "target"))]))
    return result.select(each.alias("e"), "absolute_change", "pct_change", "value_t").groupBy("e.level", "e.key").agg(F.sum("absolute_change").alias("total_change"), F.avg("pct_change").alias("mean_pct"), F.sum("value_t").alias("value_t"))


def direct_blocks(result: DataFrame) -> DataFrame:
    """For each of the three direct types that occurs: edges, value, mean and median percentage, total change."""
    rows = result.where("edge_type <> 'indirect'")
    sums = rows.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.sum("value_t").alias("value_t"), F.avg("pct_change").alias("mean_pct"), F.sum("absolute_change").alias("total_change"))
    return sums.join(exact_median(rows, ["edge_type"], "pct_change", "median_pct"), "edge_type")


def indirect_block(result: DataFrame) -> DataFrame:
    """One row about the indirect edges: how many change by over 1, 5 and 10 %, greatest, mean and sample deviation."""
    size = F.abs("pct_change")
    return result.where("edge_type = 'indirect'").agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(size > k).alias(f"over_{k}_pct") for k in (1, 5, 10)], F.max(size).alias("greatest"), F.avg("pct_change").alias("mean_pct"), F.stddev_samp("pct_change").alias("deviation"))


def shock_summary(result: DataFrame, shocked: list[str], magnitude: float) -> DataFrame:
    """One row of twelve fields."""
    kinds = [F.count_if(F.col("edge_type") == k).alias(k) for k in ("direct_outgoing", "direct_incoming", "indirect")]
    over = [F.count_if(F.abs("pct_change") > k).alias(f"edges_affected_{k}pct") for k in (1, 5, 10)]
    one = result.agg(F.lit(",".join(shocked)).alias("shocked_nodes"), F.lit(-abs(magnitude)).alias("magnitude"), F.count(F.lit(1)).alias("total_edges"), *kinds, F.sum("absolute_change").alias("total_impact"), F.avg("pct_change").alias("mean_pct_change"), *over)
    middle = exact_median(result.withColumn("one", F.lit(1)), ["one"], "pct_change", "median_pct_change")
    at = one.columns.index("mean_pct_change") + 1
    return one.withColumn("one", F.lit(1)).join(middle, "one", "left").select(*one.columns[:at], "median_pct_change", *one.columns[at:])


def effect_summary(rows: DataFrame, shocked: list[str], least: float = 0.01) -> DataFrame:
    """One row: mean effect on flows out of the shocked nodes and on all others, and how many flows it moves by more than least."""
    effect, hit = F.col("shocked_delta") - F.col("baseline_delta"), F.col("source").isin(shocked)
    return rows.agg(F.avg(F.when(hit, effect)).alias("direct_effect_mean"), F.avg(F.when(~hit, effect)).alias("indirect_effect_mean"), F.count_if(F.abs(effect) > least).alias("total_affected_edges"))


def hop_decay(effects: DataFrame, keys: tuple[str, ...] = ("year", "trial")) -> DataFrame:
    """keys, distance: edges, mean, lower median, sample deviation, percentage of drops (under -0.01) and of marked effects (over 0.01 either way)."""
    e, group = F.col("effect"), [*keys, "distance"]
    sums = effects.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_edges"), F.avg(e).alias("mean_effect"),
        F.stddev_samp(e).alias("std_effect"), (F.avg((e < -0.01).cast("double")) * 100).alias("pct_drops"), (F.avg((F.abs(e) > 0.01).cast("double")) * 100).alias("pct_significant"),
    )
    middle = exact_median(effects, group, "effect", "median_effect", lower=True)
    return sums.join(middle, group).select(*group, "n_edges", "mean_effect", "median_effect", "std_effect", "pct_drops", "pct_significant")


def over_trials(decay: DataFrame, keys: tuple[str, ...] = ("year",)) -> DataFrame:
    """Means over trials, and the interpolated median of their medians."""
    return decay.groupBy(*keys, "distance").agg(F.avg("n_edges").alias("n_edges"), F.avg("mean_effect").alias("mean_effect"), F.median("median_effect").alias("median_effect"), F.avg("pct_drops").alias("pct_drops"), F.avg("pct_significant").alias("pct_significant"))


def over_years(by_year: DataFrame) -> DataFrame:
    return by_year.groupBy("distance").agg(F.avg("mean_effect").alias("mean_effect"), F.avg("pct_drops").alias("pct_drops"))


def crisis_and_boom(by_year: DataFrame, crisis: tuple[int, ...] = (2008, 2015, 2019), boom: tuple[int, ...] = (2003, 2020)) -> DataFrame:
    """One row: mean effect one hop away in either kind of years, and which is stronger."""
    one = by_year.where("distance = 1").agg(F.avg(F.when(F.col("year").isin(*crisis), F.col("mean_effect"))).alias("crisis_effect"), F.avg(F.when(F.col("year").isin(*boom), F.col("mean_effect"))).alias("boom_effect"))
    a, b = F.abs("crisis_effect"), F.abs("boom_effect")
    return one.withColumn("verdict", F.when(a > b * 1.3, "stronger in crisis").when(a < b * 0.7, "weaker in crisis").when(a.isNotNull() & b.isNotNull(), "similar"))


def verdicts(by_distance: DataFrame) -> DataFrame:
    """One row: does the model respond to direct shocks, do they reach one hop, and how much of them."""
    one = by_distance.agg(F.max(F.when(F.col("distance") == 0, F.col("mean_effect"))).alias("direct_effect"), F.max(F.when(F.col("distance") == 1, F.col("mean_effect"))).alias("hop1_effect"))
    reach = F.abs("hop1_effect") > 0.005
    return one.select("direct_effect", "hop1_effect", (F.abs("direct_effect") > 0.01).alias("responds"), reach.alias("propagates"), F.when(reach, F.coalesce(F.try_divide("hop1_effect", "direct_effect"), F.lit(0.0))).alias("ratio"))
