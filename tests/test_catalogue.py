"""Each query against its SQL in another engine, on the smallest tables."""

import duckdb
import pytest

from waymark import catalogue, plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in plans.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", plans.names())
def test_same_rows(spark, duck, name):
    mine = catalogue.queries()[name](spark, SF).toPandas()
    theirs = duck.sql(catalogue.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    key = lambda df: sorted((tuple("null" if v != v or v is None else round(float(v), 5) if isinstance(v, float) else str(v) for v in row) for row in df[cols].itertuples(index=False)), key=str)
    assert [str(x) for x in key(mine)] == [str(x) for x in key(theirs)]


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(plans.names())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
