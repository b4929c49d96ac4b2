"""The training-data queries that SQL can express, over whole tables, against their DuckDB twins."""

import os

import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()


def plain(value):
    return list(value) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    duck = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = duck.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    want = sorted(repr([plain(dict(zip(found.columns, r))[c]) for c in columns]) for r in found.fetchall())
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want
