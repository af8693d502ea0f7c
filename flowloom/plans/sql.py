"""A registry of queries with their SQL, and the common table expressions that the SQL shares."""

from __future__ import annotations

from collections.abc import Callable

#: The trade network of sources.trade.edges.
EDGES = """WITH edges AS (
  SELECT CAST(year(o_orderdate) AS INT) AS year, 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || '_S' || (l_partkey % 5) AS source, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '_S' || (o_custkey % 5) AS target,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
"""
NODES = EDGES + """, nodes AS (SELECT id, 'Country_sector' AS label, id AS pk, split_part(id, '_', 1) AS country, substr(id, strpos(id, '_') + 1) AS sector, id AS id_str FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges))
"""


def WITH(name: str) -> str:
    """The network's year with lower values, as the matrix queries have it."""
    return EDGES + f", {name} AS (SELECT source, target, round(value - 50000, 4) AS value FROM edges WHERE year = 1998)\n"


class Queries:
    """@query(sql) registers a function (spark, sf_dir) -> DataFrame under its name; without sql it has no oracle."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.functions[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
