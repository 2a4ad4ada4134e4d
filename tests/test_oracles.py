"""Every query with SQL equals DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from lithos import catalog
from lithos.plans.views import view

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(float(v)) if type(v).__name__ in ("int", "int32", "int64", "float", "float64") else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DIR).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_layers_are_whole(spark, duck):
    """The view has every layer of a build-up, counted in the tables and not by the view's own SQL."""
    n, longest = duck.sql("SELECT sum(c), max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey)").fetchall()[0]
    got = view(spark, DIR, "layers").groupBy("build_id").count().agg({"count": "sum", "build_id": "count"}).collect()[0]
    assert longest > 5 and got["sum(count)"] == n
    assert view(spark, DIR, "layers").agg({"pos": "max"}).collect()[0][0] == longest
