from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import packing, queries


def check(sizes, capacity, item, begin, size, container, place):
    taken: dict[int, list] = {}
    parts: dict[int, list] = {}
    for i, b, s, c, p in zip(item, begin, size, container, place, strict=True):
        taken.setdefault(c, []).append((p, p + s))
        parts.setdefault(i, []).append((b, s))
    for spans in taken.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for i, own in parts.items():
        own.sort()
        assert [b for b, _ in own] == list(np.cumsum([0] + [s for _, s in own[:-1]]))
        assert sum(s for _, s in own) == sizes[i]
        assert len(own) == 1 if sizes[i] <= capacity else len(own) == -(-sizes[i] // capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=120))
def test_containers_hold(sizes):
    out = packing.pack_sizes(np.array(sizes, np.int64), 20)
    check(sizes, 20, *map(np.ndarray.tolist, out))


def test_rule_is_the_least_sum():
    rng = np.random.default_rng(2)
    rule = packing.SumOfSquares(12)
    for size in rng.integers(1, 13, 400):
        level = rule.level.copy()

        def total(h):
            after = level.copy()
            after[h] -= h > 0
            if h + size < 12:
                after[h + size] += 1
            return int((after[1:12] ** 2).sum())

        options = {h: total(h) for h in range(0, 12 - size + 1) if h == 0 or level[h]}
        _, h = rule.place(int(size))
        assert options[h] == min(options.values())


def test_little_room_is_left():
    rng = np.random.default_rng(3)
    sizes = rng.integers(20, 900, 20_000)
    container = packing.pack_sizes(sizes, 2048)[3]
    assert sizes.sum() / ((container.max() + 1) * 2048) > 0.99


@pytest.mark.parametrize("packers", [1000, 50])
def test_rows(spark, packers):
    rows = [(i, n) for i, n in enumerate([5, 0, None, 25, 10, 3, 7] * 30)] + [(None, 4), (3, 25)]
    df = spark.createDataFrame(rows, "id bigint, n int").selectExpr("*", "'x' AS packer", "1 AS place")
    out = packing.packed(df, "id", "n", 10, packers).collect()
    assert sum(r["piece_size"] for r in out) == sum(n or 0 for _, n in rows)
    assert sum(r["container"] is None for r in out) == 60
    fill: dict = {}
    for r in out:
        if r["container"] is not None:
            fill[r["container"]] = fill.get(r["container"], 0) + r["piece_size"]
    assert max(fill.values()) <= 10


def test_texts(spark):
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
    long = "word " * 5000
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "  \n"), (4, ""), (5, long), (6, "hello world")], "id bigint, text string")
    out = packing.packed_texts(df, "id", "text", path, 2048).collect()
    n = {i: sum(r["piece_size"] for r in out if r["key"] == i) for i in range(1, 7)}
    assert n[1] == n[6] == 2 and n[2] == n[3] == n[4] == 0
    assert n[5] == len(packing._encoder(path).encode_ordinary(long))
    assert packing.packed_texts(df.where("false"), "id", "text", path).count() == 0


def test_layout_does_not_matter(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k), int(n)) for k, n in zip(rng.integers(0, 200, 600), rng.integers(1, 9, 600))] + [(None, 4)] * 50
    got = []
    for parts in (2, 7):
        df = spark.createDataFrame(rows, "id bigint, n int").repartition(parts)
        got.append(sorted(packing.packed(df, "id", "n", 10, 100).collect(), key=str))
    assert got[0] == got[1] and len(got[0]) == len(rows)
