"""Wide matrices to edges and vertices; edge filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalar import country, known, sector

#: Marks of final-use columns. Fixed values.
FINAL_USE = ("HFCE", "NPISH", "GGFC", "GFCF", "INVNT", "DPABR", "OUT")
VERTEX_LABEL = "Country_sector"


def sector_columns(columns: list[str], exclude: tuple[str, ...] = FINAL_USE, exact: bool = False) -> list[str]:
    """Columns of sectors: with an underscore and none of the marks in them (exact: the sector part is none of the marks)."""
    out = []
    for c in columns:
        marked = c.partition("_")[2] in exclude or c in exclude if exact else any(m in c for m in exclude)
        if "_" in c and not marked:
            out.append(c)
    return out


def cells(wide: DataFrame, index_col: str, columns: list[str]) -> DataFrame:
    """source, target, value of the chosen columns, without missing cells."""
    rows = wide.select(F.col(f"`{index_col}`").alias("source"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = rows.unpivot("source", list(columns), "target", "value")
    return long.withColumn("value", known(F.col("value"))).where("value IS NOT NULL")


def melt_rectangular(wide: DataFrame, index_col: str, columns: list[str], min_value: float = 1e-9) -> DataFrame:
    """All rows by the chosen columns where abs(value) >= min_value; negative flows stay."""
    return cells(wide, index_col, columns).where(F.abs("value") >= min_value)


def melt_square(wide: DataFrame, index_col: str, columns: list[str], min_value: float = 0.0) -> DataFrame:
    """Rows that are among the chosen columns too; value >= min_value, or value > 0 where that is 0."""
    inside = wide.where(F.col(f"`{index_col}`").isin(list(columns)))
    return cells(inside, index_col, columns).where(F.col("value") >= min_value if min_value > 0 else F.col("value") > 0)


def vertices(labels: DataFrame, label_col: str = "id") -> DataFrame:
    """One row for each distinct label, with country and sector. Labels of rows and columns, so a vertex needs no edge."""
    ids = labels.select(F.col(label_col).alias("id")).distinct()
    return ids.select("id", F.lit(VERTEX_LABEL).alias("label"), F.col("id").alias("pk"), country(F.col("id")).alias("country"), sector(F.col("id")).alias("sector"), F.col("id").alias("id_str"))


def matrix_labels(wide: DataFrame, index_col: str, columns: list[str]) -> DataFrame:
    """Labels of the rows and of the chosen columns."""
    return wide.select(F.col(f"`{index_col}`").alias("id")).union(wide.sparkSession.createDataFrame([(c,) for c in columns], "id string")).where("id IS NOT NULL")


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids at either end."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among nodes(id)."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
