"""Every query with SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from codexlake.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sql, name):
    got = QUERIES[name](spark, DATA)
    want = sql.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted([tuple(map(plain, r)) for r in got.select(*columns).collect()])
    assert rows == sorted([tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
