"""Every registered query against DuckDB, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in entry.oracle_sql():
        rows = db.sql(entry.oracle_sql()[name])
        assert sorted(rows.columns) == columns
        want = sorted(repr(tuple(plain(dict(zip(rows.columns, r, strict=True))[c]) for c in columns)) for r in rows.fetchall())
        assert got == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
