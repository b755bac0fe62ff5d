"""The entry points, and the queries against their SQL on DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from parley.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = rows(entry.queries()[name](spark, SF).toPandas()), rows(duck.execute(registry.ORACLE[name]).df())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(entry.queries()) and set(registry.ORACLE) <= set(entry.oracle_sql())


def test_interval_join_is_no_nested_loop(spark):
    plan = registry.QUERIES["window_attr"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
