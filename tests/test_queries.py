"""Every registered core query against its SQL twin, on the smallest tables."""

import pytest
from compare import differences

from tilequarry.plans import suite

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(suite.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert not differences(spark, name, suite.QUERIES[name], suite.ORACLES[name], SF)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert suite.FLAGSHIP in suite.QUERIES
