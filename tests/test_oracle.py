"""Every query with checking SQL gives the same rows; the others give some."""

import pytest

from compare import connect, difference
from parley.registry import load

QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, con, name):
    assert difference(spark, con, QUERIES[name], ORACLE[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_some_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_registry():
    assert set(ORACLE) <= set(QUERIES)
