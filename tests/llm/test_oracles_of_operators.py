import pytest

from compare import duck_rows, rows_of
from depquarry.llm.oracles import ORACLES
from depquarry.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == duck_rows(ORACLES[name], small)
