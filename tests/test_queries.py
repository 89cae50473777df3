"""Every query of the registry on the smallest test data, against its SQL where it has one."""

import pytest

from compare import connect, same
from docflow.plans import registry


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, con, name):
    df = registry.queries()[name](spark, data)
    if name in registry.oracle_sql():
        same(df, con, registry.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
