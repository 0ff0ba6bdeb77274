from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tessel import queries as q

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in q.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def key(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_equals_oracle(spark, duck, name):
    df = q.queries()[name](spark, FOLDER)
    got = duck.execute(q.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    at = [df.columns.index(x) for x in names]
    assert sorted(key([r[i] for i in at]) for r in df.collect()) == sorted(map(key, got.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
