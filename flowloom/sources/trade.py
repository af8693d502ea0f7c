"""A trade network from order tables: nations and parts stand for countries and sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(nation: str, number: str):
    return F.concat(F.lit("N"), F.lpad(F.col(nation).cast("string"), 2, "0"), F.lit("_S"), (F.col(number) % 5).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, source, target, value: what suppliers' nations and parts sold to customers' nations in a year. Sums of money are exact.

    Keys come from the small sides, so what the large table shuffles is one row for each order line's order, and sums
    start before the last shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_partkey") % 5).alias("part"), (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("money"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("year")).join(customers, "o_custkey")
    orders = orders.select("l_orderkey", "year", node("c_nationkey", "o_custkey").alias("target"))
    rows = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey")
    return rows.groupBy("year", node("s_nationkey", "part").alias("source"), "target").agg(F.sum("money").cast("double").alias("value"))


def port_trade(spark: SparkSession, sf_dir: str, year: int = 2000) -> DataFrame:
    """Port trade of one year: brands are commodities, the customers' nations countries."""
    orders = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == year).select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.lpad(F.month("o_orderdate").cast("string"), 2, "0").alias("month"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").join(orders, "l_orderkey")
    rows = rows.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("commodity"), F.col("p_type").alias("commodity_desc")), "l_partkey")
    return rows.select("commodity", "commodity_desc", F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("cty_code"), "month", F.col("l_extendedprice").alias("value"))


def economies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as economies, their regions, and the regions and the world as aggregates. The last nation stands for ROW in the graph."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"), F.lit(False).alias("is_aggregate"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("region"), F.lit(True).alias("is_aggregate"))
    return nations.unionByName(regions)


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country, year, code, value from account balances: gdp_per_capita in 1998 and 1999, missing for every seventh nation; means of regions (none for the first) and of the world."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_regionkey", F.col("c_acctbal").cast("decimal(12,2)").alias("money"))
    rows = rows.withColumn("year", F.explode(F.array(F.lit(1998), F.lit(1999))))
    by_nation = rows.where("n_nationkey % 7 <> 0").groupBy("n_nationkey", "year").agg(F.sum("money").cast("double").alias("m"), F.count(F.lit(1)).alias("n"))
    by_region = rows.where("n_regionkey <> 0").groupBy("n_regionkey", "year").agg(F.sum("money").cast("double").alias("m"), F.count(F.lit(1)).alias("n"))
    world = rows.groupBy("year").agg(F.sum("money").cast("double").alias("m"), F.count(F.lit(1)).alias("n"))
    mean = F.col("m") / F.col("n") + (F.col("year") - 1998)
    one = lambda df, name: df.select(name.alias("country"), "year", F.lit("gdp_per_capita").alias("code"), mean.alias("value"))
    return (
        one(by_nation, F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")))
        .unionByName(one(by_region, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))))
        .unionByName(one(world, F.lit("WLD")))
    )
