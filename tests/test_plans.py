"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidewave import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
        return "null"
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got, want = rows(plans.queries()[name](spark, SF).toPandas()), rows(con.sql(plans.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]
