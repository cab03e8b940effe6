"""Every registered query gives the same rows as its SQL (small scale; tests.oracle runs others)."""

import pytest

from stewardry.plans import QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, con, data, name):
    if QUERIES[name].sql is None:
        QUERIES[name](spark, data).collect()
        return
    same, note = compare(spark, con, name, data)
    if note.endswith("EMPTY"):  # too few rows to tell: the next size must have some
        larger = data.replace("sf0.001", "sf0.01")
        same, note = compare(spark, connect(larger), name, larger)
    assert same, note
