"""Every registered query but those of the optional subpackage against its oracle, on the smallest tables."""

import pytest

from tessella.plans.catalog import ORACLES, QUERIES, flagship
from tests.conftest import same


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    same(QUERIES[name](spark, sf), duck.execute(ORACLES[name]))


def test_flagship(spark, sf):
    assert flagship(spark, sf).count() > 0


def test_entry_registers_everything():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
