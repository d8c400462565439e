from __future__ import annotations

import os

import pytest

from glossweave.llm import queries
from tests import oracle

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in queries.SQL:
        got, want = oracle.same(df, oracle.connect(DATA), queries.SQL[name])
        assert got == want and got
    else:
        assert df.count() > 0


def test_packing_fills_and_holds(spark):
    rows = queries.p6_packed(spark, DATA).collect()
    fill = {}
    for r in rows:
        if r["container"] is not None:
            fill[r["container"]] = fill.get(r["container"], 0) + r["piece_size"]
    assert max(fill.values()) <= 2048
    assert sum(fill.values()) / (2048 * len(fill)) > 0.9
