import pytest

from compare import duck_rows, rows_of
from depquarry.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == duck_rows(ORACLES[name], small)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
