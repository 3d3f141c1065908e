"""The numbered queries on the smallest tables; SQL where there is some."""

import os

import duckdb
import pytest

from barloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    rows = got.collect()
    table = "embeddings" if name.startswith("op5") else "pages" if name.startswith("op4") else "documents"
    assert rows
    if not name.startswith(("op5", "op12", "op13")):
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
        rel = con.execute(ORACLE_SQL[name])
        have = [d[0] for d in rel.description]
        order = lambda z: sorted(z, key=repr)
        assert order(tuple(r[c] for c in have) for r in rows) == order(rel.fetchall())
