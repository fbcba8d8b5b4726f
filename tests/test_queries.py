"""Every registered query against its SQL in another engine, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def value(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.queries() if n != "pipeline"])
def test_query(spark, other, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name not in entry.oracle_sql():
        return
    cursor = other.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(([value(r[names.index(c)]) for c in df.columns] for r in cursor.fetchall()), key=repr)
    assert sorted(([value(v) for v in r] for r in rows), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
