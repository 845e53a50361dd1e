"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from sonora.llm import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "benchmark", "labels", "embeddings")


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found = con.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    want = sorted(str(tuple(plain(r[found.columns.index(c)]) for c in columns)) for r in found.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
