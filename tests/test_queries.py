"""Every registered query agrees with its stated SQL result."""

import pytest

from check import compare, connect
from presslake.workloads import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(spark, db, sf_dir, name):
    ok, note = compare(spark, db, sf_dir, name)
    assert ok, note


def test_every_query_is_stated_in_sql():
    assert set(SQL) == set(QUERIES)
