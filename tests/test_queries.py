"""Every registered query of the rest of the library against its SQL form."""

import decimal
import os

import duckdb
import pytest

from siftwork.queries import ORACLE_SQL, QUERIES


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else str(v)
    return str(v)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in ORACLE_SQL:
        rel = con.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert rows == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
