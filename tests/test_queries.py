"""Every query against its SQL in DuckDB on the smallest tables, and that all whole tables are read."""

import math
import os
from collections import Counter

import duckdb
import pytest

from siltstone.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = db.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["ap50"] and 0 < df.first().ap50 < 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
