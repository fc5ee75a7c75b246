import os

import duckdb
import pytest

from lodestone.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    names = sorted(frame.columns)
    frame = frame[names].astype(object).where(frame[names].notna(), None)
    return names, sorted(tuple(repr(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in frame.values.tolist())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert rows(found.toPandas()) == rows(duck.execute(ORACLES[name]).fetchdf())
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(os.path.join(os.path.dirname(__spark_entry__.__file__), "bench.py"))


def test_filters_reach_the_scan(spark, sf):
    plan = QUERIES["filter_columns"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(c_mktsegment,BUILDING)" in plan and "coalesce" not in plan
