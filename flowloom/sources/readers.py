"""Readers of matrices, national tables, port trade, indicators and results. Each is one scan that Spark splits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.scalar import number
from flowloom.operators.edges import FINAL_USE, melt_rectangular, melt_square, sector_columns
from flowloom.schemas import RESULTS


def read_icio(spark: SparkSession, path: str, index_col: str = "V1", exclude: tuple[str, ...] = FINAL_USE, exact: bool = False) -> tuple[DataFrame, list[str]]:
    """The wide matrix with its cells as numbers (text is NULL), and its sector columns. A path that isn't there raises."""
    raw = spark.read.option("header", True).csv(path)
    if index_col not in raw.columns:
        raise ValueError(f"{path} has no column {index_col}")
    return raw.select(F.col(f"`{index_col}`"), *[number(F.col(f"`{c}`")).alias(c) for c in raw.columns if c != index_col]), sector_columns([c for c in raw.columns if c != index_col], exclude, exact)


def read_icio_years(spark: SparkSession, pattern: str, index_col: str = "V1", square: bool = True, min_value: float = 0.0) -> DataFrame:
    """year, source, target, value of all matrices that a path pattern such as ICIO/*_SML.csv finds; the year is in the file's name. Files are taken to have the same header."""
    raw = spark.read.option("header", True).csv(pattern).withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).try_cast("int"))
    columns = sector_columns([c for c in raw.columns if c not in (index_col, "year")])
    # The year rides on the row's label through the melt, so that one pass does all years.
    keyed = raw.select(F.struct("year", F.col(f"`{index_col}`").alias("source")).alias("k"), *[number(F.col(f"`{c}`")).alias(c) for c in columns])
    long = keyed.unpivot("k", columns, "target", "value").select("k.year", "k.source", "target", "value").where("value IS NOT NULL")
    if square:
        return long.where(F.col("source").isin(columns) & (F.col("value") >= min_value if min_value > 0 else F.col("value") > 0))
    return long.where(F.abs("value") >= min_value)


def read_edges(spark: SparkSession, path: str, index_col: str = "V1", square: bool = False, min_value: float | None = None) -> DataFrame:
    """source, target, value of one matrix."""
    wide, columns = read_icio(spark, path, index_col)
    melt = melt_square if square else melt_rectangular
    return melt(wide, index_col, columns, *([] if min_value is None else [min_value]))


def read_national(spark: SparkSession, pattern: str) -> DataFrame:
    """country, year, row, col, value of national tables; country and year are in the file's name (three letters, four digits, ttl)."""
    raw = spark.read.option("header", True).csv(pattern)
    columns = raw.columns[1:]
    keyed = raw.select(F.struct(F.col("_metadata.file_name").alias("f"), F.col(f"`{raw.columns[0]}`").alias("row")).alias("k"), *[number(F.col(f"`{c}`")).alias(c) for c in columns])
    long = keyed.unpivot("k", columns, "col", "value")
    name = r"([A-Z]{3})(\d{4})ttl"
    return long.select(F.regexp_extract("k.f", name, 1).alias("country"), F.regexp_extract("k.f", name, 2).try_cast("int").alias("year"), "k.row", "col", "value").where("value IS NOT NULL")


def national_balance(cells: DataFrame) -> DataFrame:
    """country, year, industry and by how much output differs from intermediate use plus value added."""
    wanted = {"TTL_INT_FNL": 1, "VALU": 1, "OUTPUT": -1}
    part = [F.sum(F.when(F.col("row") == r, F.col("value") * s)) for r, s in wanted.items()]
    sums = cells.where(F.col("row").isin(*wanted)).groupBy("country", "year", F.col("col").alias("industry")).agg(*[p.alias(f"p{i}") for i, p in enumerate(part)])
    return sums.select("country", "year", "industry", (F.coalesce("p0", F.lit(0.0)) + F.coalesce("p1", F.lit(0.0)) + F.coalesce("p2", F.lit(0.0))).alias("difference")).where("p2 IS NOT NULL")


def national_edges(cells: DataFrame) -> DataFrame:
    """year, source, target, value between the industries of a country: rows TTL_<industry> by industry columns, as COUNTRY_INDUSTRY."""
    rows = cells.where(F.startswith("row", F.lit("TTL_")) & ~F.col("row").isin("TTL_INT_FNL")).withColumn("industry", F.substring("row", 5, 64))
    industries = rows.select("country", "year", F.col("industry").alias("col")).distinct()
    return rows.join(industries, ["country", "year", "col"], "left_semi").select("year", F.concat_ws("_", "country", "industry").alias("source"), F.concat_ws("_", "country", "col").alias("target"), "value")


def read_port_trade(spark: SparkSession, path: str, value_col: str, prefix: str = "E", level: str | None = None) -> DataFrame:
    """Port trade from saved responses: each file is a list of lists of texts whose first names the columns. Each response is one text, read by a task of its own."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.from_json("value", "array<array<string>>").alias("rows")).select(F.get("rows", F.lit(0)).alias("head"), F.explode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1)))).alias("r"))
    cell = lambda name: F.get(F.col("r"), (F.array_position("head", F.lit(name)) - 1).cast("int"))
    out = rows.select(cell(f"{prefix}_COMMODITY").alias("commodity"), cell(f"{prefix}_COMMODITY_SDESC").alias("commodity_desc"), cell("CTY_CODE").alias("cty_code"), cell("MONTH").alias("month"), number(cell(value_col)).alias("value"), *([cell("COMM_LVL").alias("level")] if level else []))
    return out.where(F.col("level") == level).drop("level") if level else out


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """country, year, code, value from a wide CSV with a column for each year (`1998` or `YR1998`) beside country and code."""
    raw = spark.read.option("header", True).csv(path)
    years = [c for c in raw.columns if c.removeprefix("YR").isdigit()]
    keyed = raw.select(F.struct("country", "code").alias("k"), *[number(F.col(f"`{c}`")).alias(c) for c in years])
    long = keyed.unpivot("k", years, "y", "value")
    return long.select("k.country", F.regexp_extract("y", r"(\d+)", 1).cast("int").alias("year"), "k.code", "value").where("value IS NOT NULL")


def read_indicator_pages(spark: SparkSession, path: str) -> DataFrame:
    """country, year, code, value from saved pages of an indicator service, one file a page in folders code=/year=/page=.

    A page is a list of its head and its rows (countryiso3code, date, value). Code and year are the folders', so a filter
    on them decides which pages are opened. A page without rows gives none; one that is no JSON raises when it is read.
    """
    strict = {"mode": "FAILFAST"}
    pages = spark.read.text(path, wholetext=True)
    body = F.get(F.from_json("value", "array<string>", strict), F.lit(1))
    rows = pages.select(F.col("code").cast("string").alias("code"), F.col("year").cast("int").alias("year"), F.explode(F.from_json(body, "array<struct<countryiso3code:string,date:string,value:double>>", strict)).alias("r"))
    return rows.select(F.col("r.countryiso3code").alias("country"), "year", "code", F.col("r.value").alias("value")).where("value IS NOT NULL")


def read_economies(spark: SparkSession, path: str) -> DataFrame:
    """id, region and is_aggregate from a CSV of economies with columns id, region and aggregate (true or false); an empty region is missing."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select("id", F.nullif(F.trim("region"), F.lit("")).alias("region"), F.coalesce(F.lower("aggregate") == "true", F.lit(False)).alias("is_aggregate"))


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """loss and the nested metrics of each <loss>_model/results.json."""
    rows = spark.read.schema(RESULTS).option("multiLine", True).option("allowNonNumericNumbers", True).json(pattern)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_model/[^/]*$", 1).alias("loss"), *rows.columns)


def read_graph_years(spark: SparkSession, path: str, years: list[int]) -> DataFrame:
    """Stored edges of the years that there are; only their folders are read."""
    return spark.read.parquet(path).where(F.col("year").isin(years))


def as_result_json(test_metrics: dict, best_val: dict, best_epoch: int, args: dict) -> str:
    return json.dumps({"test_metrics": test_metrics, "best_val_metrics": best_val, "best_epoch": best_epoch, "args": {k: str(v) for k, v in args.items()}})
