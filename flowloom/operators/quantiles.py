"""Exact medians of groups of any size, by narrowing down."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.shared import written

LARGEST = 1.7976931348623157e308


def exact_median(rows: DataFrame, keys: list[str], value: str, name: str, lower: bool = False, most: int = 100_000, buckets: int = 4096) -> DataFrame:
    """keys and the exact median of value for each group (the lower one, or the mean of the two in the middle); NULL where all values are.

    Spark's own keeps all different values of a group in one task. Here the range of a group's values is cut into
    buckets (even ones of the logarithm and of the values by turns), which are counted; only what lies in those of the
    wanted places goes on, until no group has more than `most` different values left or it gets no fewer. These alone
    are put in order.
    """
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    ks = list(names.values())
    rows = rows.select(*[F.col(k).alias(n) for k, n in names.items()], F.col(value).cast("double").alias("v"))
    counts = written(rows.groupBy(*ks, "v").agg(F.count(F.lit(1)).alias("c")), "values")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ks], F.lit(True))
    aside = lambda df, *more: df.select(*[F.col(k).alias(f"_{k}") for k in ks], *more)

    held = counts.where("v IS NOT NULL")
    middle = F.floor((F.sum("c") + 1) / 2)
    # first and last: the wanted places; below: rows under what is held; m: different values held.
    state = held.groupBy(*ks).agg(middle.alias("first"), (middle if lower else F.floor(F.sum("c") / 2) + 1).alias("last"), F.lit(0).cast("bigint").alias("below"), F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state, sizes, turn = written(state, "bands"), [], 0
    while True:
        sizes.append(state.agg(F.max("m")).first()[0] or 0)
        if sizes[-1] <= most or (len(sizes) > 2 and sizes[-1] >= sizes[-3]):
            break

        def scale(x: Column, turn: int = turn) -> Column:
            """Orders of magnitude in one turn, values in the next."""
            x = F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST))
            return x / 2 if turn % 2 else F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.ln(F.abs(F.when(x == 0, F.lit(1.0)).otherwise(x))) + 746))

        own = held.join(aside(state, "first", "last", "below", "lo", "hi"), same)
        part = F.coalesce(F.try_divide(scale(F.col("v")) - scale(F.col("lo")), scale(F.col("hi")) - scale(F.col("lo"))), F.lit(0.0))
        parts = own.groupBy(*ks, "first", "last", "below", F.least(F.floor(part * buckets), F.lit(buckets - 1)).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*ks).orderBy("b"))  # a row for each bucket
        wanted = parts.withColumn("upto", upto).where((F.col("upto") >= F.col("first")) & (F.col("upto") - F.col("c") < F.col("last")))
        state = written(wanted.groupBy(*ks, "first", "last").agg(F.min(F.col("upto") - F.col("c")).alias("below"), F.sum("m").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "bands")
        held = written(held.join(aside(state, "lo", "hi"), same).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select(*ks, "v", "c"), "values")
        turn += 1
    band = held.join(aside(state, "first", "last", "below"), same)
    band = band.withColumn("upto", F.col("below") + F.sum("c").over(Window.partitionBy(*ks).orderBy("v")))
    at = [F.max(F.when((F.col("upto") - F.col("c") < F.col(p)) & (F.col("upto") >= F.col(p)), F.col("v"))) for p in ("first", "last")]
    out = aside(band.groupBy(*ks).agg((at[0] if lower else (at[0] + at[1]) / 2).alias(name)), name)
    return counts.select(*ks).distinct().join(out, same, "left").select(*[F.col(n).alias(k) for k, n in names.items()], name)
