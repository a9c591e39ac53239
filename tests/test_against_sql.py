"""Every query over the test tables that has SQL for another engine is held against it there, row by row."""

import glob
import os
from collections import Counter

import pytest

from tessel.operators import interfaces, passthrough, roundtrips

QUERIES = {**passthrough.QUERIES, **roundtrips.QUERIES, **interfaces.QUERIES}
ORACLES = {**passthrough.ORACLES, **roundtrips.ORACLES, **interfaces.ORACLES}


@pytest.fixture(scope="module")
def other(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(value):
    """Floats that differ in the last places only are equal."""
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf, other, name):
    df, want = QUERIES[name](spark, sf), other.sql(ORACLES[name])
    cols = list(want.columns)
    assert sorted(cols) == sorted(df.columns)
    rows = lambda found: Counter(str(tuple(map(plain, r))) for r in found)
    assert rows(map(tuple, df.select(*cols).collect())) == rows(want.fetchall())


def test_settings_are_put_back(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError):
        interfaces.with_settings(spark, {key: "3", "spark.sql.windowExec.buffer.spill.threshold": "9"}, lambda: 1 / 0)
    assert spark.conf.get(key) == before and spark.conf.get("spark.sql.windowExec.buffer.spill.threshold", None) != "9"
