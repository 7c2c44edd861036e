import pytest

from quarryline.plans import code_queries, table_queries as t  # noqa: F401
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(t.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, t.QUERIES[name], t.ORACLES[name])
