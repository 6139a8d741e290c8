"""Every query with SQL against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from grafloom.plans import catalogue, edit_queries, more_queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    rel = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in rel.fetchall())
    assert got == want


def test_clusters(spark):
    rows = catalogue.QUERIES["hierarchical_clusters"](spark, DATA).collect()
    parent = {(r.level, r.title): r.community for r in rows}
    for r in rows:
        if r.level:
            assert parent[r.level - 1, r.title] == r.parent
