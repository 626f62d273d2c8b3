"""Every registered query of the engine against its SQL form, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from docgrain.plans.oracle import ORACLE
from docgrain.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE:
        assert got
        return
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
