"""Every query of the network against its SQL on the smallest tables, and that the entry works without the llm parts."""

import importlib
import math
import os
import sys

import pytest

from flowloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


def normal(rows, columns):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in at) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_and_sql_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    want = con.fetchall()
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert normal(got.collect(), got.columns) == normal(want, columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_repeat(spark, name):
    one = registry.queries()[name](spark, SF)
    assert sorted(map(str, one.collect())) == sorted(map(str, registry.queries()[name](spark, SF).collect()))


def test_entry_without_llm(monkeypatch):
    for m in [m for m in sys.modules if m.startswith(("flowloom.llm", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "flowloom.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
