"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

import math
import os
from collections import Counter

import duckdb
import pytest

from passagework.queries import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Many rounds of small jobs; tests/test_operators.py has its communities on a planted graph.
SLOW = {"communities"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in registry.oracle_sql():
        cur = duck.execute(registry.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
