import pytest

from vitaframe.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

from oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "rank" or entry.entry(spark).count() > 0
