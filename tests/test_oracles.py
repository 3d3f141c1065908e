"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from barloom.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    rel = duck.execute(ORACLE_SQL[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == names
    want = sorted([tuple(plain(r[have.index(c)]) for c in names) for r in rel.fetchall()])
    assert sorted([tuple(plain(r[c]) for c in names) for r in got.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
