"""Country indicators on nodes: rest-of-world means, and gaps filled from the region, then the world."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalar import country

#: Names of the seven indicators. Fixed values.
CODES = ("gdp_per_capita", "gdp_growth", "exports_pct_gdp", "imports_pct_gdp", "trade_pct_gdp", "inflation", "unemployment_rate")
REST, WORLD = "ROW", "WLD"
#: Regions of economies that the metadata lacks. Fixed value.
OVERRIDE = {"TWN": "EAS"}


def rest_of_world(indicators: DataFrame, nodes: DataFrame, economies: DataFrame, aggregates: bool = False) -> DataFrame:
    """country ROW, year, code, value: mean over economies that the graph doesn't have, gaps skipped."""
    present = nodes.select(country(F.col("id")).alias("id")).distinct()
    others = economies.where(F.lit(aggregates) | ~F.coalesce("is_aggregate", F.lit(False))).select("id").join(present, "id", "left_anti")
    rows = indicators.join(others.withColumnRenamed("id", "country"), "country", "left_semi")
    return rows.groupBy("year", "code").agg(F.avg("value").alias("value")).select(F.lit(REST).alias("country"), "year", "code", "value")


def fill_indicators(nodes: DataFrame, indicators: DataFrame, economies: DataFrame, override: dict[str, str] | None = None, codes: tuple[str, ...] = CODES) -> DataFrame:
    """country, year, code, value for each country of the graph, each year of indicators and each code.

    Own value, else the region's, else the world's, else NULL. ROW takes the rest-of-world mean and is never filled.
    """
    override = OVERRIDE if override is None else override
    countries = nodes.select(country(F.col("id")).alias("country")).distinct()
    named = F.create_map(*[F.lit(x) for pair in (override or {"": ""}).items() for x in pair])
    region = economies.select(F.col("id").alias("country"), F.col("region").alias("own_region"))
    countries = countries.join(region, "country", "left").withColumn("region", F.coalesce(F.try_element_at(named, F.col("country")), "own_region")).drop("own_region")
    years = indicators.select("year").distinct()
    grid = countries.withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes])))
    grid = grid.join(F.broadcast(years.groupBy().agg(F.sort_array(F.collect_set("year")).alias("years")).withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes])))), "code").withColumn("year", F.explode("years")).drop("years")
    with_rest = indicators.where(F.col("country") != REST).select("country", "year", "code", "value").unionByName(rest_of_world(indicators, nodes, economies))
    own = with_rest.groupBy("country", "year", "code").agg(F.max("value").alias("value"))
    regions = economies.select("region").where("region IS NOT NULL").unionByName(countries.select("region")).distinct()
    of_region = indicators.join(regions.withColumnRenamed("region", "country"), "country", "left_semi").select(F.col("country").alias("region"), "year", "code", F.col("value").alias("region_value"))
    world = indicators.where(F.col("country") == WORLD).select("year", "code", F.col("value").alias("world_value"))
    rows = grid.join(own, ["country", "year", "code"], "left").join(of_region, ["region", "year", "code"], "left").join(F.broadcast(world), ["year", "code"], "left")
    # Without a region there is nothing to look up, the world's value neither.
    wide = F.coalesce("value", F.when(F.col("region").isNotNull() & (F.col("region") != ""), F.coalesce("region_value", "world_value")))
    return rows.select("country", "year", "code", F.when(F.col("country") == REST, F.col("value")).otherwise(wide).alias("value"))


def node_indicators(nodes: DataFrame, filled: DataFrame, codes: tuple[str, ...] = CODES) -> DataFrame:
    """year, node and one column for each code, then log_gdp_per_capita in place of gdp_per_capita. The schema is the same whatever is missing."""
    wide = filled.groupBy("country", "year").pivot("code", list(codes)).agg(F.first("value"))
    rows = nodes.select(F.col("id").alias("node"), country(F.col("id")).alias("country")).join(wide, "country")
    names = [c for c in codes if c != "gdp_per_capita"]
    return rows.select("year", "node", *names, F.log1p("gdp_per_capita").alias("log_gdp_per_capita"))
