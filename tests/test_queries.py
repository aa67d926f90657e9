"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.sql(entry.oracle_sql()[name])
    at = [cur.columns.index(c) for c in cols]
    assert sorted(cur.columns) == cols
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_first_component_has_scores(spark):
    values = [r.value for r in entry.queries()["t10_first_component"](spark, DATA).collect()]
    assert values and all(v is None or math.isfinite(v) for v in values)
