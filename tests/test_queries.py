"""Every query with SQL against DuckDB over the same tables; the others run."""

import math
from glob import glob
from pathlib import Path

import duckdb
import pytest

from wakeline.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def _row(columns, values):
    out = []
    for _, v in sorted(zip(columns, values, strict=True)):
        out.append(None if v is None else round(float(v), 5) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v)
    return tuple(out)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted((_row(df.columns, r) for r in df.collect()), key=repr)
    q = duck.sql(SQL[name])
    want = sorted((_row(q.columns, r) for r in q.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(q.columns)
    assert len(got) == len(want) and len(got) > 0
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-5)), (g, w)
