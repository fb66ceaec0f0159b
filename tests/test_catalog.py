import pytest

from tests.compare import assert_same
from tidemill.plans import catalog

ORACLE = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert assert_same(catalog.queries()[name](spark, sf), sf, ORACLE[name]) > 0


def test_entry_module(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(catalog.queries()) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0
