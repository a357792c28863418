"""Every query of the catalogue against its SQL, and the entry module's contract."""

import pytest

import __spark_entry__ as entry
from corpusmill.plans import catalogue
from tests.compare import agree

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    agree(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    # the smallest documents hold no similar pair
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0 or name == "lsh_pairs"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
