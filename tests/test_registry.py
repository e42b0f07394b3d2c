"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from siftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 9) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(map(plain, r)) for r in df.collect()]
    columns = ", ".join(f'"{c}"' for c in df.columns)
    expected = [tuple(map(plain, r)) for r in duck.sql(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_common_identity_reads_all_documents(spark, duck):
    """Every document is in a batch, and batches with and without an identity come from the key alone."""
    out = registry.queries()["common_identity_all"](spark, SF).collect()
    assert sum(r["n"] for r in out) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert {r["region"] is None for r in out if r["batch"].startswith("any-")} == {True} and {r["region"] is None for r in out if not r["batch"].startswith("any-")} == {False}
