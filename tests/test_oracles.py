"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from strataledger import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rounded(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted(str(tuple(map(rounded, r))) for r in found.fetchall())
    ours = sorted(str(tuple(rounded(r[c]) for c in columns)) for r in df.collect())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_other_queries_have_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
