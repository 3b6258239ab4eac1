import pytest
from duck import check, connect

from tessera import oracle, queries


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(queries.found))
def test_query_equals_its_sql(spark, small, duck, name):
    check(spark, duck, small, queries.found[name], oracle.SQL[name])
