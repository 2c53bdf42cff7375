"""Every core query against its SQL, run by DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from pagemill.queries import ORACLE, QUERIES


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else repr(x)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, data, con, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(con.execute(ORACLE[name]).df())


def test_queries_without_sql_run(spark, data):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, data).count() > 0
