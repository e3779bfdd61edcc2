"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    got = sorted([plain(r[c]) for c in sorted(names)] for r in df.collect())
    assert got == sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
