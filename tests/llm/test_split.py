from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import split


def greedy(natural, limit, overlap):
    n, begin, out = len(natural), 0, []
    while True:
        if n - begin <= limit:
            return [*out, (begin, n)]
        ends = [e for e in range(begin + overlap + 1, begin + limit + 1) if natural[e - 1]]
        end = ends[-1] if ends else begin + limit
        out.append((begin, end))
        begin = end - overlap


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=120), min_size=1, max_size=5), st.integers(4, 20), st.integers(0, 3))
def test_pointer_doubling_equals_greedy(seqs, limit, overlap):
    natural = np.array([x == 0 for s in seqs for x in s])
    lens = np.array([len(s) for s in seqs])
    seq, begin, end = split.piece_bounds(natural, lens, limit, overlap)
    want = [(i, b, e) for i, s in enumerate(seqs) for b, e in greedy([x == 0 for x in s], limit, overlap)]
    assert sorted(zip(seq.tolist(), begin.tolist(), end.tolist())) == sorted(want)


def test_rows(spark):
    long = [1] * 40
    long[9] = 7
    rows = [("a", long, "x"), ("a", long, "y"), ("b", [1] * 5, "x"), (None, long, "x"), ("c", None, "x"), ("d", [], "x"), ("e", [None] * 30, "x"), ("f", list(range(1000, 26000)), "x")]
    df = spark.createDataFrame(rows, "id string, words array<bigint>, key string")
    enders = spark.createDataFrame([(7,), (7,), (None,)], "t bigint")
    for most in (100, 0):
        out = split.split_long(df, "id", "words", enders, limit=10, overlap=2, most_enders=most).collect()
        got = sorted((r["key"], r["begin"], r["end"]) for r in out)
        want = []
        for key, words in (("a", long), ("e", [None] * 30), ("f", list(range(1000, 26000)))):
            want += [(key, b, e) for b, e in greedy([w == 7 for w in words], 10, 2)]
        assert got == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "id string, words array<bigint>")
    assert split.split_long(df, "id", "words", spark.createDataFrame([], "t bigint")).count() == 0
