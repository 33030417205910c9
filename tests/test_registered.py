import pytest
from conftest import same_rows

from jobloom import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLES:
        assert same_rows(df, registry.ORACLES[name], DATA)
    else:
        assert df.count() > 0
