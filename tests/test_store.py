"""Versions by year, lookups by buckets, medians by narrowing, and samples by lots."""

import hashlib
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowloom.operators.quantiles import exact_median
from flowloom.operators.shocks import exactly
from flowloom.sources.store import LookupTables, YearStore

EDGES = "year int, source string, target string, value double"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.select("year", "source", "target", "value").collect()))


def test_only_touched_years_are_written(spark, tmp_path):
    store = YearStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        store.read()
    first = [(1, "a", "b", 1.0), (1, "b", "a", 2.0), (2, "a", "b", 3.0)]
    assert store.insert_if_absent(spark.createDataFrame(first, EDGES)) == 1 and rows_of(store.read()) == first
    held = files(tmp_path / "data")
    assert store.insert_if_absent(spark.createDataFrame([(2, "a", "b", 9.0), (2, "c", "a", 4.0), (2, "c", "a", 4.0)], EDGES)) == 2
    assert rows_of(store.read()) == [*first, (2, "c", "a", 4.0)] and held <= files(tmp_path / "data")
    one, two = store.last(1).folders, store.last().folders
    assert one[1] == two[1] and one[2] != two[2]
    assert store.upsert(spark.createDataFrame([(1, "a", "b", 7.0), (3, "x", "y", 5.0)], EDGES)) == 3
    assert rows_of(store.read()) == [(1, "a", "b", 7.0), (1, "b", "a", 2.0), (2, "a", "b", 3.0), (2, "c", "a", 4.0), (3, "x", "y", 5.0)] and rows_of(store.read(version=1)) == first
    before = files(tmp_path / "data")
    assert store.clear([2]) == 4 and {r[0] for r in rows_of(store.read())} == {1, 3} and files(tmp_path / "data") == before
    assert rows_of(store.read(years=[3])) == [(3, "x", "y", 5.0)]
    plan = store.read(years=[3])._jdf.queryExecution().toString()
    assert "year=3" in str(store.read(years=[3]).inputFiles()) and all("year=3" in f for f in store.read(years=[3]).inputFiles()) and plan


def test_a_change_that_breaks_off_leaves_the_version_before(spark, tmp_path):
    store = YearStore(spark, str(tmp_path))
    store.insert_if_absent(spark.createDataFrame([(1, "a", "b", 1.0)], EDGES))
    broken = spark.createDataFrame([(1, "c", "d", 1.0)], EDGES).withColumn("value", F.when(F.col("source") == "c", F.raise_error(F.lit("no"))).otherwise(0.0))
    with pytest.raises(Exception, match="no"):
        store.upsert(broken)
    assert store.last().version == 1 and rows_of(store.read()) == [(1, "a", "b", 1.0)]


def test_lookups_read_one_bucket(spark, tmp_path):
    rng = random.Random(0)
    edges = list({(1998, f"n{rng.randrange(40)}", f"n{rng.randrange(40)}"): float(i) for i in range(500)}.items())
    df = spark.createDataFrame([(*k, v) for k, v in edges], EDGES)
    tables = LookupTables(spark, f"edges_{os.getpid()}").write(df, str(tmp_path), 16)
    out = tables.outgoing("n3")
    assert rows_of(out) == rows_of(df.where("source = 'n3'")) and rows_of(tables.incoming("n5")) == rows_of(df.where("target = 'n5'")) and rows_of(tables.flow("n3", "n5")) == rows_of(df.where("source = 'n3' AND target = 'n5'"))
    # Files of other buckets are left out either way; the plan says so for a scan by buckets.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    assert "SelectedBucketsCount: 1 out of 16" in tables.outgoing("n3")._jdf.queryExecution().executedPlan().treeString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


@pytest.mark.parametrize("most, buckets", [(5, 32), (100_000, 4096)])
def test_medians_by_narrowing(spark, most, buckets):
    rng = random.Random(most)
    groups = {
        "spread": [rng.choice((-1, 1)) * 10 ** rng.uniform(-200, 200) for _ in range(301)], "even": [rng.random() for _ in range(300)], "ties": [1.0] * 50 + [2.0] * 49 + [rng.random() for _ in range(30)], "one": [4.0],
        "zeros": [-0.0, 0.0, 0.0, 1.0], "edges": [float("-inf"), float("inf"), 1.0, 2.0, 3.0, 1e308, -1e308], None: [3.0, 1.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("spread", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for lower in (True, False):
        got = {r.g: r.m for r in exact_median(df, ["g"], "v", "m", lower, most, buckets).collect()}
        assert got.pop("none") is None
        assert got == {g: (statistics.median_low if lower else statistics.median)(v) for g, v in groups.items()}


@pytest.mark.parametrize("most", [0.0002, 50_000])
def test_samples_by_lots_of_more_digits(spark, most):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    got = {(r.g, r.k) for r in exactly(df, ["g"], ["k"], F.when(F.col("g") == 0, 10).otherwise(F.col("g") * 300), 5, most).collect()}
    want = set()
    for g in range(3):
        order = sorted((hashlib.md5(f"5|{k}".encode()).hexdigest(), k) for k in range(g, 3000, 3))
        want |= {(g, k) for _, k in order[: 10 if g == 0 else g * 300]}
    assert got == want
