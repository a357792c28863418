"""The package's queries against their SQL."""

import pytest

from corpusmill.llm import queries
from tests.compare import agree


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    agree(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001")
