"""Edges that arrive as files: strengths by year kept up to date, and labels of the years that a batch touches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.features import label_trade_drops
from flowloom.schemas import EDGES


def stream_edges(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of edges from a folder of Parquet files."""
    reader = spark.readStream.schema(EDGES)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def running_strengths(edges: DataFrame) -> DataFrame:
    """year, node, in_strength, out_strength of all that has come so far: the state has a row for each year and node."""
    ends = edges.select("year", F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("value").alias("out"), F.lit(0.0).alias("in")), F.struct(F.col("target").alias("node"), F.lit(0.0).alias("out"), F.col("value").alias("in")))).alias("e"))
    return ends.select("year", "e.*").groupBy("year", "node").agg(F.sum("in").alias("in_strength"), F.sum("out").alias("out_strength"))


def relabel(edges: DataFrame, table_path: str, labels: Callable[[DataFrame, list[int]], None], checkpoint: str, threshold: float = 0.1) -> StreamingQuery:
    """Put each batch into the edge table (a folder for each batch and year) and hand `labels` the new labels of the years that it touches.

    A batch that runs again after a failure writes its own folder anew, so nothing counts twice.
    """

    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]  # batches of another checkpoint have numbers of their own

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").partitionBy("year").parquet(f"{table_path}/batch={run}-{number}")
        years = sorted({y for r in rows.select("year").distinct().collect() for y in (r.year - 1, r.year, r.year + 1)})
        near = sorted({y + k for y in years for k in (-1, 0, 1)})
        stored = spark.read.schema(EDGES).option("basePath", table_path).parquet(table_path).select("year", "source", "target", "value").where(F.col("year").isin(near))
        summed = stored.groupBy("year", "source", "target").agg(F.sum("value").alias("value"))
        labels(label_trade_drops(summed, threshold).where(F.col("year").isin(years)), years)

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
