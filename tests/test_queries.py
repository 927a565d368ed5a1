"""Every query that has SQL gives the SQL's rows."""

import os

import duckdb
import pytest

from loamspark.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def text(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return f"{float(v):.9g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_the_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted("|".join(text(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted("|".join(text(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
