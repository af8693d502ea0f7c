"""Edges kept by year in versions, and edges laid out for lookups by their ends.

YearStore: a folder for each year and a table of versions, each the list of the folders that it consists of. A change
writes the years that it touches into new folders and then adds a version; others stay where they are. Spark moves a
version's row into place as a whole, so a change that breaks off leaves the version before it. One writer at a time.

LookupTables: two copies of the edges, in buckets by source and by target, sorted inside, with Bloom filters: a lookup
reads one bucket and in it the pages that can hold the node.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class YearStore:
    """Rows with a column year at path. keys: what tells rows of a year apart."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("source", "target")) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), ("year", *keys)

    def versions(self) -> DataFrame:
        """version, folders (by year), schema. Empty before the first write."""
        schema = "version bigint, folders map<int,string>, schema string"
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.path}/versions") if there else self.spark.createDataFrame([], schema)

    def last(self, version: int | None = None):
        rows = self.versions()
        return (rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version")).limit(1)).first()

    def read(self, years: list[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some years: no other folder is opened."""
        one = self.last(version)
        if one is None:
            raise ValueError("no such version")
        folders = [f for y, f in sorted(one.folders.items()) if years is None or y in years]
        if not folders:
            return self.spark.createDataFrame([], one.schema)
        return self.spark.read.schema(one.schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{f}" for f in folders]).drop("written")

    def change(self, years: list[int], rows: DataFrame | None) -> int:
        """A version in which rows, if any, stand for those of the years; a year without rows goes. Gives its number."""
        one = self.last()
        number, batch = (one.version + 1 if one else 1), uuid.uuid4().hex
        there: set[int] = set()
        if rows is not None and years:
            out = f"{self.path}/data/written={batch}"
            rows.write.partitionBy("year").parquet(out)
            there = {r.year for r in self.spark.read.schema(rows.schema).parquet(out).select("year").distinct().collect()}
        folders = {y: f for y, f in (one.folders if one else {}).items() if y not in years} | {y: f"data/written={batch}/year={y}" for y in there}
        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) if rows is not None else one.schema if one else ""
        self.spark.createDataFrame([(number, folders, schema)], "version bigint, folders map<int,string>, schema string").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return number

    def touched(self, rows: DataFrame) -> tuple[list[int], DataFrame | None]:
        """The years of rows, a few by nature, and what is held of them."""
        years = sorted(r.year for r in rows.select("year").distinct().collect())
        return years, self.read(years) if self.last() else None

    def insert_if_absent(self, rows: DataFrame) -> int:
        """Adds the rows whose keys are not held yet; of rows with the same keys one."""
        years, held = self.touched(rows)
        new = rows.dropDuplicates(list(self.keys))
        return self.change(years, new if held is None else held.unionByName(new.join(held.select(*self.keys), list(self.keys), "left_anti")))

    def upsert(self, rows: DataFrame) -> int:
        """Puts the rows in place of those with the same keys, and adds the others."""
        years, held = self.touched(rows)
        new = rows.dropDuplicates(list(self.keys))
        return self.change(years, new if held is None else held.join(new.select(*self.keys), list(self.keys), "left_anti").unionByName(new))

    def clear(self, years: list[int]) -> int:
        """A version without the years; nothing is written but the version, and nothing is deleted."""
        return self.change(years, None)


class LookupTables:
    """Tables {name}_by_source and {name}_by_target in the session's catalog."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name

    def write(self, edges: DataFrame, path: str, buckets: int = 64) -> LookupTables:
        """buckets: as many as keep one at about a row group. Each is written by one task."""
        for end in ("source", "target"):
            out = edges.repartition(buckets, end).write.format("parquet").option("path", f"{path}/{end}").option(f"parquet.bloom.filter.enabled#{end}", "true")
            out.bucketBy(buckets, end).sortBy(end).saveAsTable(f"{self.name}_by_{end}")
        return self

    def outgoing(self, node: str) -> DataFrame:
        return self.spark.table(f"{self.name}_by_source").where(F.col("source") == node)

    def incoming(self, node: str) -> DataFrame:
        return self.spark.table(f"{self.name}_by_target").where(F.col("target") == node)

    def flow(self, source: str, target: str) -> DataFrame:
        return self.outgoing(source).where(F.col("target") == target)
