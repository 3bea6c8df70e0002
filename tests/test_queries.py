import pytest

import __spark_entry__ as driver
import check

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert sum(r["n"] for r in rows) == 500


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, name):
    results = {n: status for n, status, _ in check.compare(spark, SF, [name])}
    assert results[name].startswith("ok"), results[name]


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    """In its registered form; what it returns is held against brute force in the other tests."""
    results = {n: status for n, status, _ in check.compare(spark, SF, [name])}
    assert results[name].startswith("rows only"), results[name]
    assert results[name] != "rows only: 0"
