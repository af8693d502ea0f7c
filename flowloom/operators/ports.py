"""Port trade: cleaning, months as columns, commodities with their least trade in the middle month, and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalar import month_name, number
from flowloom.shared import written
from flowloom.sources.writers import write_csv

MONTHS = ("08", "09", "10")
KEYS = ("commodity", "commodity_desc", "cty_code")


def cleaned(trade: DataFrame, months: tuple[str, ...] = MONTHS) -> DataFrame:
    """Rows of the months with a positive value and with a commodity and a country. Text values are read as numbers."""
    rows = trade.withColumn("value", number(F.col("value").cast("string")))
    keyed = [F.col(c).isNotNull() for c in KEYS]
    return rows.where((F.col("value") > 0) & (F.col("commodity") != "-") & (F.col("cty_code") != "-") & F.col("month").isin(*months) & keyed[1])


def by_month(trade: DataFrame, months: tuple[str, ...] = MONTHS) -> DataFrame:
    """KEYS and a column for each month, NULL where there was no trade. Values of the pivot are given, so no job looks for them."""
    names = [{"08": "Aug", "09": "Sep", "10": "Oct"}.get(m, f"m{m}") for m in months]
    wide = trade.groupBy(*KEYS).pivot("month", list(months)).agg(F.sum("value"))
    return wide.toDF(*KEYS, *names)


def v_shaped(wide: DataFrame) -> DataFrame:
    """Rows with more trade before and after the middle month than in it; a missing month doesn't count as less."""
    before, middle, after = wide.columns[-3:]
    return wide.where((F.col(before) > F.col(middle)) & (F.col(after) > F.col(middle)))


def share(wide: DataFrame) -> DataFrame:
    """One row: groups, V-shaped groups, both totals, and the share of these in percent (0 without trade)."""
    before, middle, after = wide.columns[-3:]
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in (before, middle, after)), F.lit(0.0))
    v = F.coalesce((F.col(before) > F.col(middle)) & (F.col(after) > F.col(middle)), F.lit(False))
    total, part = F.coalesce(F.sum(value), F.lit(0.0)), F.coalesce(F.sum(F.when(v, value)), F.lit(0.0))
    return wide.agg(F.count(F.lit(1)).alias("commodities"), F.count_if(v).alias("v_commodities"), total.alias("total"), part.alias("v_total"), F.when(total > 0, F.try_divide(part, total) * 100).otherwise(0.0).alias("share_pct"))


def analyse(trade: DataFrame, path: str, months: tuple[str, ...] = MONTHS) -> DataFrame:
    """The whole analysis: writes the filtered rows as they are to path/filtered and the V-shaped groups with their months to path/v_shape, both as CSV, and returns the row of share()."""
    rows = written(cleaned(trade, months), "ports")
    wide = by_month(rows, months)
    write_csv(rows, f"{path}/filtered")
    write_csv(v_shaped(wide), f"{path}/v_shape")
    return share(wide)


def totals_by_month(trade: DataFrame) -> DataFrame:
    """month (three letters) and its total."""
    return trade.groupBy(month_name(F.col("month")).alias("month")).agg(F.sum("value").alias("total"))
