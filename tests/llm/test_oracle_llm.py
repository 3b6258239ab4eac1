import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from duck import check, connect  # noqa: E402

from tessera.llm import oracle, queries  # noqa: E402


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, small, duck, name):
    check(spark, duck, small, queries.queries()[name], oracle.SQL[name])
