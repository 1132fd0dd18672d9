"""Every query runs; those with SQL give the other engine's rows."""

import pytest
from compare import assert_same

from stathouse.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    out = QUERIES[name](spark, data)
    if name in ORACLE_SQL:
        assert_same(out, ORACLE_SQL[name], data)
    else:
        assert out.count() > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
