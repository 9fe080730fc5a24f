"""Every registered query runs, and equals its SQL on the smallest tables."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return None if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("p") or n in entry.oracle_sql()])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(columns) == len(set(columns))
        return
    assert sorted(duck.sql(sql).columns) == columns
    assert rows == Counter(tuple(map(plain, r)) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_need_no_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    assert out.returncode == 0 and int(out.stdout.split()[-1]) == len(NAMES)
