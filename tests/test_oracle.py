"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from cadenza.plans.all_queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    r = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted([plain(x[names.index(c)]) for c in cols] for x in r.fetchall())
