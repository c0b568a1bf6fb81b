"""Every query of the reference's operators against its SQL."""

import pytest
from compare import SF, assert_same, connect

from pellucid import plans


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_oracle(spark, duck, name):
    assert_same(plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["Sample_Count", "Accuracy", "F1", "Precision", "Recall"]
    assert set(e.oracle_sql()) <= set(e.queries())
