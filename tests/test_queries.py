"""Every query against its SQL in DuckDB, on the smallest test tables."""

import glob
import math
import os

import duckdb
import pytest

from waymark.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(cols, data):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    if name in registry.oracle_sql():
        rel = duck.sql(registry.oracle_sql()[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert got == rows(rel.columns, rel.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_filters_reach_the_scan(spark, tmp_path):
    from waymark.operators.events import When

    spark.createDataFrame([(1, 2)], "entity_id long, julian_day long").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where(When(1998).predicate())
    assert "GreaterThanOrEqual(julian_day" in df._jdf.queryExecution().toString()
