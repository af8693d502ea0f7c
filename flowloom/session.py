"""A session with the settings that the operators are written for. ANSI mode stays on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "flowloom", **conf: str) -> SparkSession:
    """Adaptive execution, UTC and Arrow; further settings by keyword, with `__` for a dot."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
