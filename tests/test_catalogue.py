from __future__ import annotations

import os

import pytest

from glossweave import catalogue
from tests import oracle

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name in catalogue.SQL:
        got, want = oracle.same(df, con, catalogue.SQL[name])
        assert got == want
        assert got or name == "entity_freq_having"  # nothing is that frequent at this size
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["doc", "begin", "end", "entity", "score"] and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
