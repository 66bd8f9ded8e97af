"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from pagewright.plans import corpus, document, reference

assert document  # adds its queries to those of `reference`
SQL = {**reference.SQL, **corpus.SQL}
QUERIES = {**reference.QUERIES, **corpus.QUERIES}
D = os.environ.get("PAGEWRIGHT_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    fix = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return Counter(map(tuple, pdf.astype(object).where(pdf.notna(), None).map(fix).values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, D).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() >= 0
