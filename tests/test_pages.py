"""Saved pages: a round trip, and that a filter on code or year opens no other page."""

import pytest
from pyspark.sql import functions as F

from flowloom.sources.readers import read_indicator_pages, read_port_trade
from flowloom.sources.writers import write_indicator_pages

ROWS = [(f"C{i:02d}", year, code, float(i) + year / 3) for i in range(25) for year in (1998, 1999) for code in ("gdp", "pop")] + [("C99", 1998, "gdp", None), ("C00", 2001, "gdp", 1.5)]


@pytest.fixture
def pages(spark, tmp_path):
    write_indicator_pages(spark.createDataFrame(ROWS, "country string, year int, code string, value double"), str(tmp_path), 5)
    return tmp_path


def rows_of(df):
    return sorted(map(tuple, df.select("country", "year", "code", "value").collect()))


def test_pages_come_back(spark, pages):
    assert rows_of(read_indicator_pages(spark, str(pages))) == sorted(r for r in ROWS if r[3] is not None)
    assert 3 <= len(list((pages / "code=gdp" / "year=1999").glob("page=*"))) <= 5


def test_other_pages_are_not_opened(spark, pages):
    for year in (1998, 2001):
        for f in (pages / "code=gdp" / f"year={year}").glob("page=*/*.txt"):
            f.write_text("no JSON")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    one = read_indicator_pages(spark, str(pages)).where((F.col("year") == 1999) & (F.col("code") == "gdp"))
    assert rows_of(one) == sorted(r for r in ROWS if r[1:3] == (1999, "gdp"))
    scan = next(line for line in one._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan text" in line)
    assert "PartitionFilters: [isnotnull" in scan
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        read_indicator_pages(spark, str(pages)).where("year = 1998 AND code = 'gdp'").collect()


def test_a_page_without_rows(spark, tmp_path):
    for page, text in enumerate(('[{"message": "none"}]', '[{"page": 2}, null]', '[{"page": 3},\n [{"countryiso3code": "AAA", "date": "1998", "value": 2, "unit": ""}]]')):
        at = tmp_path / "code=gdp" / "year=1998" / f"page={page}"
        at.mkdir(parents=True)
        (at / "page.txt").write_text(text)
    assert rows_of(read_indicator_pages(spark, str(tmp_path))) == [("AAA", 1998, "gdp", 2.0)]


def test_port_trade_over_several_lines(spark, tmp_path):
    """A response is one text, however its lines are broken."""
    (tmp_path / "a.json").write_text('[["E_COMMODITY", "E_COMMODITY_SDESC", "CTY_CODE", "MONTH", "ALL_VAL_MO"],\n ["c1", "d1", "x", "08",\n "10"],\n ["c2", "d2", "y", "09", "5"]]\n')
    (tmp_path / "b.json").write_text('[["MONTH", "ALL_VAL_MO", "CTY_CODE", "E_COMMODITY", "E_COMMODITY_SDESC"],\n["10", "7", "z", "c3", "d3"]]')
    got = sorted(map(tuple, read_port_trade(spark, str(tmp_path), "ALL_VAL_MO").collect()))
    assert got == [("c1", "d1", "x", "08", 10.0), ("c2", "d2", "y", "09", 5.0), ("c3", "d3", "z", "10", 7.0)]
