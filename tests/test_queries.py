"""Every registered engine query against its DuckDB SQL."""

import math
import os

import duckdb
import pytest

from qscope import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in queries.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return "" if v is None else str(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    out = queries.QUERIES[name](spark, SF)
    rows, cols = out.collect(), sorted(out.columns)
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(queries.ORACLE_SQL[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
