"""Every registered query of the engine against DuckDB."""

import pytest

from lodestone.plans.queries import ORACLES, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
