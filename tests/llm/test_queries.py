import pytest

from termloom.llm import queries
from tests.util import assert_same


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, sf, name):
    if name in queries.SQL:
        assert_same(spark, name, queries.QUERIES[name], queries.SQL[name], sf)
    else:
        assert queries.QUERIES[name](spark, sf).count() >= 0
