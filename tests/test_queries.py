"""Every registered query of the reference's own operators runs; those with SQL equal it."""

import math

import duckdb
import pytest

from sonora.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return out


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = con.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, abs=2e-5) for x, y in zip(a, b, strict=True))


def test_native_queries_have_no_python(spark):
    for name in ("auroc_by_lang", "metric_summary", "policy_apply", "energy_vad_segments", "fuse_language_votes", "word_reliability", "shannon_entropy"):
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name
