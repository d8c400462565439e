from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import topn

SCHEMA = "chunk string, begins array<bigint>, ents array<array<bigint>>, scores array<array<float>>, key string, item int"


def brute(rows, n):
    best = defaultdict(dict)
    for chunk, begins, ents, scores, *_ in rows:
        if chunk is None or begins is None or ents is None or scores is None:
            continue
        for b, es, ss in zip(begins, ents, scores):
            if b is None or es is None or ss is None:
                continue
            for e, s in zip(es, ss):
                if e and s is not None and not math.isnan(s):
                    own = best[chunk, b]
                    own[e] = max(own.get(e, -math.inf), s)
    return {(c, b, e) for (c, b), own in best.items() for e, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n]}


def run(spark, rows, n=2, **kw):
    out = topn.strongest(spark.createDataFrame(rows, SCHEMA), "chunk", "begins", "ents", "scores", n=n, **kw).collect()
    got = {(r["key"], r["slot"], r["item"]) for r in out}
    assert len(got) == len(out)
    return got


def test_dirty_rows(spark):
    nan = float("nan")
    rows = [
        ("a", [0, 3], [[5, 6, 7], [8]], [[0.1, 0.9, 0.9], [nan]], "x", 1),
        ("a", [0, None], [[5, 0, 9], [4]], [[1.5, 9.0], [1.0]], None, None),
        ("a", [3], [None], [[1.0]], "x", 1),
        ("a", None, [[1]], [[1.0]], "x", 1),
        (None, [0], [[1]], [[1.0]], "x", 1),
        ("b", [1], [[3, None, 2, 2]], [[float("-inf"), 1.0, 0.5, None]], "x", 1),
        ("b", [1], [[2]], [[0.5]], "x", 1),
        ("c", [1, 1], [[3], [1]], [[0.5], [0.5]], "x", 1),
        ("d", [], [], [], "x", 1),
        ("e", [1], [[3]], None, "x", 1),
        ("f", [1], [[3], [4]], [[1.0], [1.0]], "x", 1),
    ] * 2
    assert run(spark, rows) == brute(rows, 2)


def test_empty(spark):
    assert run(spark, []) == set()


def test_hot_group_over_many_tasks(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", [0], [[int(x) for x in rng.integers(1, 4000, 8)]], [[float(x) for x in rng.integers(0, 50, 8)]], "x", 1) for _ in range(3000)]
    assert run(spark, rows, 5, buffer_rows=100) == brute(rows, 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(1, 6), st.integers(0, 4)), max_size=60), st.integers(1, 4))
def test_cut_is_mergeable(rows, n):
    a = np.array(rows, np.int64).reshape(-1, 4)
    cut = lambda x: x[topn._kept(x[:, 0], x[:, 1], x[:, 2], x[:, 3].astype(float), n)] if len(x) else x
    whole = cut(a)
    halves = cut(np.concatenate([cut(a[::2]), cut(a[1::2])]))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, halves))


def test_bounds_keep_all_that_may_get_in():
    rng = np.random.default_rng(4)
    make = lambda n: pa.table([pa.array([f"k{i}" for i in rng.integers(0, 4, n)]), rng.integers(-1, 3, n), rng.integers(1, 30, n), np.round(rng.random(n), 1)], schema=topn.SCHEMA)
    for _ in range(30):
        old, new = make(120), make(60)
        heaps = topn._compact(old, 3)
        kept = topn._Bounds(heaps, 3).above(new)
        whole, cut = (sorted(topn._compact(pa.concat_tables([heaps, x]), 3).to_pylist(), key=str) for x in (new, kept))
        assert whole == cut and kept.num_rows < new.num_rows
