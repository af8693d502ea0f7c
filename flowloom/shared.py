"""Where all machines can write: intermediate tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset a folder of our own on a local master, as in tests, and an error on any other."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = f"{tempfile.gettempdir()}/flowloom-shared"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read it instead of working it out again, and a lost executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/flowloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
