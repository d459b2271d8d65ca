"""Every core query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandline.plans import registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def text(x):
    if x is None or x != x or str(x) in ("NaT", "<NA>"):
        return "NULL"
    return str(round(float(x), 5)) if isinstance(x, (int, float)) or hasattr(x, "item") else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def test_queries_without_sql_are_few():
    assert sorted(set(registry.queries()) - set(registry.oracle_sql())) == ["edits_own_block", "events_bootstrap", "events_calibration", "events_permutation", "events_random_trait", "reads_decoy_excess", "writers_name_conformity_test"]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    sql = registry.oracle_sql().get(name)
    got = registry.queries()[name](spark, SF if sql else LARGER).toPandas()
    if sql is None:
        assert len(got), "a query without SQL must give rows"
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda frame: sorted(tuple(map(text, row)) for row in frame[order].itertuples(index=False))
    assert key(got) == key(want)


def test_plans_push_down(spark):
    """Filters and columns reach the scans."""
    plan = registry.queries()["reads_page_hours"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "logged_at" in plan and "rel_first_post_s" not in plan
