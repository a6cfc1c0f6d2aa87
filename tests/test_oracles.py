"""Every registered query with an oracle, side by side on the smallest sample."""

import pytest

import __spark_entry__ as entry
import check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, con, small, name):
    text, _, _ = check.compare(spark, con, small, name, QUERIES[name], ORACLES[name])
    assert text.startswith("ok"), text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
