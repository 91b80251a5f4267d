"""Named queries against their SQL, over whole tables of the smallest size."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
NAMES = [n for n in entry.queries() if n in SQL and not n[1:2].isdigit()]


@pytest.fixture(scope="session")
def db(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def key(row):
    return tuple((v is not None, "nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) else str(v)) for v in row)


def same(spark, db, data, name):
    got = entry.queries()[name](spark, data)
    cols = sorted(got.columns)
    a = [tuple(r) for r in got.select(*cols).collect()]
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    b = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({SQL[name]})").fetchall()
    a, b = sorted(map(key, a)), sorted(map(key, b))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for (p, v), (q, w) in zip(x, y):
            assert p == q and (v == w or isinstance(v, float) and abs(v - w) <= 2e-6 * max(1, abs(v))), (name, x, y)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, db, data, name):
    same(spark, db, data, name)


@pytest.mark.parametrize("name", [n for n in ("p3_found", "p4_found", "p6_found") if n in SQL])
def test_preparation_against_sql(spark, db, data, name):
    same(spark, db, data, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())


def test_core_does_not_import_llm():
    import pathlib

    import sonarlake

    root = pathlib.Path(sonarlake.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "sonarlake.llm" not in p.read_text()
