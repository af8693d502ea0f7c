"""Writers: snapshots by year, CSV, JSON, a metrics log, and an outside store by partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_years(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A Parquet folder for each year. Rows are dealt by year and a salt, so that no year is one task's."""
    rows.repartition("year", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "year"][:2]), F.lit(8))).write.mode(mode).partitionBy("year").parquet(path)


def write_indicator_pages(rows: DataFrame, path: str, size: int = 1000, mode: str = "overwrite") -> None:
    """country, year, code, value as pages that read_indicator_pages reads, of about `size` rows each: a code and year has as many as its rows ask for, dealt by a hash of the country."""
    counts = rows.groupBy("code", "year").agg(F.ceil(F.count(F.lit(1)) / size).alias("pages"))
    dealt = rows.join(counts, ["code", "year"]).withColumn("page", F.pmod(F.xxhash64("country"), F.col("pages")) + 1)
    row = F.struct(F.col("country").alias("countryiso3code"), F.col("year").cast("string").alias("date"), "value")
    bodies = dealt.groupBy("code", "year", "page", "pages").agg(F.to_json(F.collect_list(row)).alias("body"))
    text = F.concat(F.lit("["), F.to_json(F.struct("page", "pages")), F.lit(","), "body", F.lit("]"))
    bodies.select(text.alias("value"), "code", "year", "page").write.mode(mode).partitionBy("code", "year", "page").text(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def log_metrics(spark: SparkSession, path: str, values: dict[str, float], step: int) -> None:
    """Append (name, value, step) to the metrics log."""
    spark.createDataFrame([(k, float(v), step) for k, v in values.items()], "name string, value double, step bigint").write.mode("append").parquet(path)


def micro_batches(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most `size` rows."""
    if size < 1:
        raise ValueError("size must be positive")
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def send(rows: DataFrame, to: Callable[[list], None], size: int = 500) -> None:
    """Hand the rows to an outside store in batches, from the tasks. A task that runs again sends its batches again, so `to` must take repeats (insert if absent)."""

    def part(rows: Iterator) -> None:
        for batch in micro_batches(rows, size):
            to([r.asDict() for r in batch])

    rows.foreachPartition(part)
