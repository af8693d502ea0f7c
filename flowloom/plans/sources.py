"""Queries on sources, sinks and stores: derived tables are written as a source has them, into the shared folder, and read back. Each has its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowloom.operators.edges import melt_rectangular
from flowloom.plans.network import LARGE, NODE, all_edges, rounded, wide
from flowloom.plans.sql import EDGES, WITH, Queries
from flowloom.shared import shared_dir
from flowloom.sources import readers, store, trade, writers

query = Queries()


def place(spark, what: str) -> str:
    return f"{shared_dir(spark)}/flowloom-{what}-{uuid.uuid4().hex}"


@query(WITH("m") + "SELECT source, target, value FROM m WHERE abs(value) >= 1000")
def icio_scan_S1(spark, sf_dir):
    """The wide matrix as CSV, through the reader and the rectangular melt."""
    path = place(spark, "icio")
    writers.write_csv(wide(spark, sf_dir), path)
    matrix, columns = readers.read_icio(spark, path)
    return rounded(melt_rectangular(matrix, "V1", columns, 1000), 4, "value")


@query(WITH("m") + "SELECT source, target, value FROM m WHERE value > 0")
def icio_edges_S9(spark, sf_dir):
    """The same in one call; cells of text are no values."""
    path = place(spark, "icio")
    writers.write_csv(wide(spark, sf_dir).withColumn("N00_HFCE", F.lit("n/a")), path)
    return rounded(readers.read_edges(spark, path, square=True), 4, "value")


@query(EDGES + f""", c AS (SELECT split_part(source, '_', 1) AS country, year, split_part(target, '_', 2) AS industry, sum(value) FILTER (source < target) AS a, sum(value) FILTER (source >= target) AS b, sum(value) AS o FROM edges GROUP BY ALL)
SELECT country, year, industry, round(coalesce(a, 0) + coalesce(b, 0) - 2 * o, 4) AS difference FROM c""")
def national_balance_S2(spark, sf_dir):
    """Long cells of national tables, as the reader of those gives them: intermediate use, value added and twice their sum as output."""
    rows = all_edges(spark, sf_dir).select(F.substring_index("source", "_", 1).alias("country"), "year", F.substring_index("target", "_", -1).alias("col"), "value", (F.col("source") < F.col("target")).alias("less"))
    cells = [(F.when(F.col("less"), "TTL_INT_FNL").otherwise("VALU"), F.col("value")), (F.lit("OUTPUT"), F.col("value") * 2)]
    each = F.explode(F.array(*[F.struct(r.alias("row"), v.alias("value")) for r, v in cells]))
    return rounded(readers.national_balance(rows.select("country", "year", "col", each.alias("c")).select("country", "year", "c.row", "col", "c.value")), 4, "difference")


IND = """WITH r AS (SELECT n_nationkey, n_regionkey, CAST(c_acctbal AS DECIMAL(12, 2)) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey), y AS (SELECT unnest([1998, 1999]) AS year)
SELECT * FROM (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country, year, 'gdp_per_capita' AS code, round(CAST(sum(m) AS DOUBLE) / count(*) + (year - 1998), 6) AS value FROM r CROSS JOIN y WHERE n_nationkey % 7 <> 0 GROUP BY n_nationkey, year
UNION ALL SELECT 'R' || n_regionkey, year, 'gdp_per_capita', round(CAST(sum(m) AS DOUBLE) / count(*) + (year - 1998), 6) FROM r CROSS JOIN y WHERE n_regionkey <> 0 GROUP BY n_regionkey, year
UNION ALL SELECT 'WLD', year, 'gdp_per_capita', round(CAST(sum(m) AS DOUBLE) / count(*) + (year - 1998), 6) FROM r CROSS JOIN y GROUP BY year)"""


@query(IND)
def indicator_scan_S7(spark, sf_dir):
    """A wide CSV with a column for each year, resolved to long rows."""
    path = place(spark, "indicators")
    rows = trade.indicators(spark, sf_dir)
    writers.write_csv(rows.groupBy("country", "code").pivot("year", [1998, 1999]).agg(F.first("value")).withColumnRenamed("1999", "YR1999"), path)
    return rounded(readers.read_indicators(spark, path), 6, "value")


SIDES = """SELECT split_part(source, '_', 1) AS country, year, 'exports' AS code, value FROM edges UNION ALL SELECT split_part(target, '_', 1), year, 'imports', value FROM edges"""


@query(EDGES + f"SELECT country, year, code, round(sum(value), 4) AS value FROM ({SIDES}) GROUP BY ALL")
def paged_indicators_S5(spark, sf_dir):
    """Exports and imports of each country and year, saved as pages of ten rows and read back."""
    path = place(spark, "pages")
    edges = all_edges(spark, sf_dir)
    sides = [edges.select(F.substring_index(end, "_", 1).alias("country"), "year", F.lit(code).alias("code"), "value") for end, code in (("source", "exports"), ("target", "imports"))]
    writers.write_indicator_pages(sides[0].unionByName(sides[1]).groupBy("country", "year", "code").agg(F.sum("value").alias("value")), path, 10)
    return rounded(readers.read_indicator_pages(spark, path), 4, "value")


@query("SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, 'R' || n_regionkey AS region, false AS is_aggregate FROM nation UNION ALL SELECT 'R' || r_regionkey, NULL, true FROM region")
def economies_scan_S6(spark, sf_dir):
    path = place(spark, "economies")
    writers.write_csv(trade.economies(spark, sf_dir).select("id", "region", F.col("is_aggregate").cast("string").alias("aggregate")), path)
    return readers.read_economies(spark, path)


@query(EDGES + "SELECT year, source, target, value FROM edges WHERE year IN (1996, 1998)")
def graph_years_S8(spark, sf_dir):
    """Snapshots by year, of which two are read."""
    path = place(spark, "years")
    writers.write_years(all_edges(spark, sf_dir), path)
    return readers.read_graph_years(spark, path, [1996, 1998]).select("year", "source", "target", "value")


@query(EDGES + "SELECT year, source, target, round(value, 4) AS value FROM edges")
def csv_sink_S12(spark, sf_dir):
    path = place(spark, "csv")
    writers.write_csv(all_edges(spark, sf_dir), path)
    return rounded(spark.read.option("header", True).schema("year int, source string, target string, value double").csv(path), 4, "value")


@query(EDGES + "SELECT year, source, target, round(value, 4) AS value FROM edges")
def json_sink_S13(spark, sf_dir):
    path = place(spark, "json")
    writers.write_json(all_edges(spark, sf_dir), path)
    return rounded(spark.read.schema("year int, source string, target string, value double").json(path), 4, "value")


@query(EDGES + f"SELECT year, source, target, CASE WHEN value >= {LARGE} THEN -value ELSE value END AS value FROM edges WHERE year <> 1995")
def store_changes_S11(spark, sf_dir):
    """A store by year: rows of all years, then the same again, then the large flows of each year anew, then a year less; what the last version holds."""
    edges = all_edges(spark, sf_dir)
    kept = store.YearStore(spark, place(spark, "store"))
    kept.insert_if_absent(edges)
    kept.insert_if_absent(edges.withColumn("value", F.lit(0.0)))
    kept.upsert(edges.where(F.col("value") >= LARGE).withColumn("value", -F.col("value")))
    kept.clear([1995])
    return kept.read().select("year", "source", "target", "value")


@query(EDGES + f"SELECT 'out' AS side, year, source, target, value FROM edges WHERE source = '{NODE}' UNION ALL SELECT 'in', year, source, target, value FROM edges WHERE target = '{NODE}'")
def lookup_tables_G6(spark, sf_dir):
    """All years' flows out of a node and into it, from copies of the edges in buckets by either end: each side reads one bucket."""
    tables = store.LookupTables(spark, f"flowloom_edges_{uuid.uuid4().hex}").write(all_edges(spark, sf_dir), place(spark, "lookup"), 16)
    sides = [rows.select(F.lit(side).alias("side"), "year", "source", "target", "value") for side, rows in (("out", tables.outgoing(NODE)), ("in", tables.incoming(NODE)))]
    return sides[0].unionByName(sides[1])
