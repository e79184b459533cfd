import pytest

from ratelake.plans import catalog

from .sql_check import DATA, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, name):
    got, want = same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert got == want


def test_baseline_model_is_better_than_chance(spark):
    r = catalog.QUERIES["baseline_text_model"](spark, "/root/testdata/sf0.01").first()
    assert r["n_test"] > 50 and r["n_correct"] / r["n_test"] > 0.75


def test_entry_is_registered(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == catalog.QUERIES["bill_versions_and_riders"](spark, DATA).columns
