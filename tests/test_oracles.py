"""Every registered query against its SQL; queries without SQL must at least run."""

import pytest

from tests.oracle import compare, connect
from tidemark.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], data) == ""
    else:
        df = QUERIES[name](spark, data)
        assert len(df.columns) == len(set(df.columns))
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
