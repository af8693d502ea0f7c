"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.shared import shared_dir, written


__all__ = ["blocks", "bucketed", "fresh", "literal_rows", "offsets", "own_columns", "shared_dir", "short_batches", "table", "utf8", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """docs, with Arrow batches of at most `rows` rows in its session where Spark's default of 10,000 holds: texts are long, and both sides keep whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(name) == "10000":
        docs.sparkSession.conf.set(name, str(rows))
    return docs


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, beginning as `name`."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(docs: DataFrame, less: tuple[str, ...] = ()) -> list[Column]:
    """The columns of docs whatever their names hold, but for those named in less."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in less]


def bucketed(df: DataFrame, key: str, what: str) -> DataFrame:
    """df as a table in the shared folder, in as many buckets by key as there are shuffle partitions: later groupings and joins by key need no shuffle of it."""
    spark = df.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"flowloom_{what}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    return spark.table(name)


def literal_rows(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A small table of equally long lists of values, made by the JVM alone."""
    zipped = F.arrays_zip(*[F.lit(v).alias(c) for c, v in columns.items()])
    return spark.range(0, 1, 1, 1).select(F.explode(zipped).alias("r")).select(*[F.col("r")[c].alias(c) for c in columns])


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each, and a row at least: bounds what numpy holds, never cuts a text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(ends, ends[row] + most, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row)
            row = end


def offsets(texts: pa.Array) -> np.ndarray:
    """Ends of the texts in their data buffer, the first start included."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts of a column one after the other, and where each begins and ends in them. A null has no bytes."""
    ends = offsets(texts)
    data = texts.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    if texts.null_count:  # a null may hold bytes in the buffer
        return utf8(texts.fill_null(""))
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
