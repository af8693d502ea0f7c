"""Natural shocks, seeded samples of exact size, and random shock trials."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalar import SMALL, log_change, relative_change
from flowloom.shared import written


def edge_shocks(rows: DataFrame, threshold: float = 0.15) -> DataFrame:
    """rows(value_t, value_t1) with shocked: whether the flow falls by more than threshold."""
    return rows.withColumn("shocked", relative_change(F.col("value_t"), F.col("value_t1")) < -threshold)


def node_shocks(rows: DataFrame, nodes: DataFrame, share: float = 0.2) -> DataFrame:
    """year, node, shocked for each of nodes(year, node): whether more than share of the flows out of it are shocked; without any it is not."""
    per = rows.groupBy("year", F.col("source").alias("node")).agg((F.count_if("shocked") / (F.count(F.lit(1)) + SMALL)).alias("part"))
    return nodes.select("year", "node").join(per, ["year", "node"], "left").select("year", "node", F.coalesce(F.col("part") > share, F.lit(False)).alias("shocked"))


def with_target(rows: DataFrame) -> DataFrame:
    return rows.withColumn("target_delta", log_change(F.col("value_t"), F.col("value_t1")))


def seeded(seed: int, keys: list[str]) -> Column:
    """An order of rows by the seed and their keys that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def exactly(rows: DataFrame, partition: list[str], keys: list[str], size: Column, seed: int, most: int = 50_000) -> DataFrame:
    """`size` rows (the same for all rows of a partition) of each partition, the first by a seeded hash of the keys: exact, without replacement, the same each time.

    No partition is sorted as a whole: the hash's first digits deal it into lots; lots before the boundary are taken
    whole, and only the boundary's own lot is ranked. There are as many digits as keep lots under about `most` rows.
    """
    names = rows.columns
    rows = written(rows.withColumns({"__hash": seeded(seed, keys), "__size": size}), "hashed")  # read three times
    digits, count = 3, rows.count()
    while count > most * 16**digits:
        digits += 1
    rows = rows.withColumn("__lot", F.left("__hash", F.lit(digits)))
    lots = rows.groupBy(*partition, "__lot").agg(F.count(F.lit(1)).alias("__n"))
    # Lots are summed up in front of their first three digits' last ones, then in front of each other's.
    head, start = F.left("__lot", F.lit(3)), Window.partitionBy(*partition)
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = lots.groupBy(*partition, head.alias("__head")).agg(F.sum("__n").alias("__n")).withColumn("__above", before(start.orderBy("__head")))
    tops = tops.select(*[F.col(c).alias(f"__{c}") for c in (*partition, "__head")], "__above")
    inside = lots.withColumn("__head", head).withColumn("__in", before(Window.partitionBy(*partition, "__head").orderBy("__lot")))
    in_top = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*partition, "__head")])
    lots = inside.join(tops, in_top).select(*[F.col(c).alias(f"__{c}") for c in partition], F.col("__lot").alias("____lot"), "__n", (F.col("__above") + F.col("__in")).alias("__before"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*partition, "__lot")])
    held = rows.join(lots, same).where(F.col("__before") < F.col("__size"))
    place = F.row_number().over(Window.partitionBy(*partition, "__lot").orderBy("__hash", *keys))
    cut = held.where(F.col("__before") + F.col("__n") > F.col("__size")).withColumn("__place", place).where(F.col("__before") + F.col("__place") <= F.col("__size"))
    return held.where(F.col("__before") + F.col("__n") <= F.col("__size")).select(*names).unionByName(cut.select(*names))


def kind(rows: DataFrame, eps: float) -> Column:
    return F.when(F.col("target_delta") > eps, "gain").when(F.col("target_delta") < -eps, "drop").otherwise("neutral")


def balanced_sizes(rows: DataFrame, ratio: float = 1.0, eps: float = 1e-3) -> DataFrame:
    """year, take_gain, take_drop, take_neutral: how many of each class a balanced sample has."""
    n = rows.withColumn("kind", kind(rows, eps)).groupBy("year").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("gain", "drop", "neutral")])
    gain = F.least("gain", F.col("drop") if ratio == 1.0 else F.floor(F.col("drop") * ratio))
    n = n.withColumn("take_gain", gain)
    drop = F.col("take_gain") if ratio == 1.0 else F.least("drop", F.floor(F.col("take_gain") / ratio))
    return n.select("year", "take_gain", drop.alias("take_drop"), F.least("neutral", F.floor(F.col("take_gain") * 0.1)).alias("take_neutral"))


def balanced_sample(rows: DataFrame, ratio: float = 1.0, eps: float = 1e-3, seed: int = 0, part: float = 1.0) -> DataFrame:
    """As many gains as drops (or ratio times as many), and a tenth as many neutral edges, for each year; with part a smaller sample of that."""
    named = rows.withColumn("kind", kind(rows, eps)).join(F.broadcast(balanced_sizes(rows, ratio, eps)), "year")
    size = F.when(F.col("kind") == "gain", F.col("take_gain")).when(F.col("kind") == "drop", F.col("take_drop")).otherwise(F.col("take_neutral"))
    out = exactly(named, ["year", "kind"], ["source", "target"], size, seed)
    if part < 1.0:
        out = exactly(out, ["year"], ["source", "target"], F.floor((F.col("take_gain") + F.col("take_drop") + F.col("take_neutral")) * part), seed + 1)
    return out.drop("take_gain", "take_drop", "take_neutral")


def shock_sample(rows: DataFrame, ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """All shocked edges, and normal ones up to ratio of all, for each year. rows: with shocked."""
    sizes = rows.groupBy("year").agg(F.greatest(F.lit(0), F.floor(F.count(F.lit(1)) * ratio) - F.count_if("shocked")).alias("take"))
    normal = exactly(rows.where(~F.col("shocked")).join(F.broadcast(sizes), "year"), ["year"], ["source", "target"], F.col("take"), seed).drop("take")
    return rows.where("shocked").unionByName(normal)


def synthetic_masks(edges: DataFrame, shocked: DataFrame) -> DataFrame:
    """edges with shocked: whether the source is among shocked(id)."""
    mark = shocked.select(F.col("id").alias("source"), F.lit(True).alias("shocked")).distinct()
    return edges.join(mark, "source", "left").withColumn("shocked", F.coalesce("shocked", F.lit(False)))


def shock_trials(nodes: DataFrame, trials: int = 20, least: int = 5, most: int = 10, seed: int = 0) -> DataFrame:
    """trial, node: for each trial between least and most nodes, drawn by seeded hashes."""
    rows = nodes.select(F.col(nodes.columns[0]).alias("node")).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    size = least + F.conv(F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("size"), F.col("trial").cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("bigint") % (most - least + 1)
    return exactly(rows, ["trial"], ["trial", "node"], size, seed).select("trial", "node")
