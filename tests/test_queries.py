"""Every query of the record against its SQL, at the smallest scale."""

import pytest

from ledgerline.plans import registry
from tests.oracle import assert_equal, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert_equal(df, con, registry.ORACLES[name])
    else:
        assert df.count() > 0  # test_folds.py holds these against brute force


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
