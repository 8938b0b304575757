"""Every registered query of the core library against its SQL twin."""

import oracle
import pytest

from textquarry import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert oracle.difference(db, catalog.QUERIES[name](spark, sf_dir), catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
