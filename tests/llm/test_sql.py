"""The corpus queries that have SQL, against DuckDB over the same whole tables, all columns."""

import math
from glob import glob
from pathlib import Path

import duckdb
import pytest

from wakeline.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    q = duck.sql(queries.oracle_sql()[name])
    assert columns == sorted(q.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(q.select(*columns).fetchall(), key=repr)
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9)), (g, w)
