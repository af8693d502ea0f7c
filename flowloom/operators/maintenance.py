"""Adding to and clearing node and edge tables. A change is a new version of the table, written by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the least by `order`, or else by all its columns, so that a run again keeps the same."""
    rest = [c for c in rows.columns if c not in keys]
    least = F.min(F.struct(*(order or []), *[c for c in rest if c not in (order or [])])).alias("__r") if rest else None
    return rows.groupBy(*keys).agg(least).select(*[f"__r.{c}" if c in rest else c for c in rows.columns]) if rest else rows.distinct()


def insert_if_absent(new: DataFrame, old: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of new whose keys old doesn't have, the first by `order` (such as a line number) for each key, with missing properties left NULL."""
    return first_of_each(new, keys, order).join(old.select(*keys), keys, "left_anti").select(*new.columns)


def upsert(new: DataFrame, old: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The whole new version: rows of new, and those of old with other keys."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(first_of_each(new, keys, order))


def clear_partition(nodes: DataFrame, edges: DataFrame, key: str | None = None, value: str | None = None, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes where key is value and the edges at either side of them. Without key and value all goes, which needs confirm."""
    if (key is None) != (value is None):
        raise ValueError("key and value go together")
    if key is None:
        if not confirm:
            raise ValueError("clearing everything needs confirm=True")
        return nodes.limit(0), edges.limit(0)
    doomed = nodes.where(F.col(key) == value).select("id")
    kept = edges.join(doomed.select(F.col("id").alias("source")), "source", "left_anti").join(doomed.select(F.col("id").alias("target")), "target", "left_anti")
    return nodes.where(~F.col(key).eqNullSafe(F.lit(value))), kept.select(*edges.columns)
