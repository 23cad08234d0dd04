"""Every registered query with SQL is held against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lumenreel.plans import catalogue

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) or str(v).lstrip("-").isdigit() else str(v)
    return cols, sorted((tuple(clean(v) for v in r) for r in frame[cols].itertuples(index=False)), key=str)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_duckdb(spark, duck, name):
    got = rows(catalogue.QUERIES[name](spark, SF).toPandas())
    want = rows(duck.execute(catalogue.ORACLES[name]).fetchdf())
    assert got == want


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
