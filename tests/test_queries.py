import pytest

from quern.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        ok, say = compare(df, registry.oracle_sql()[name], SF)
        assert ok, say
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
