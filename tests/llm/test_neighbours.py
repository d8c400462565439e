from __future__ import annotations

import contextlib
import tracemalloc

import numpy as np
import pyarrow as pa

from glossweave.llm import neighbours


def data(n=900, copies=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[1::3] = x[::3] + 0.1 * rng.normal(size=x[1::3].shape)
    x[n - copies :] = x[0]  # a third are copies of one vector
    return x


def brute(x, k, rounds=6):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, rounds)
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]}


def run(spark, x, **kw):
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    bad = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 3, 1), (9004, [float("nan")] * 16, 1), (None, [1.0] * 16, 1), (9005, [None] * 16, 1), (9006, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows + rows[:5] + bad, "id bigint, v array<float>, key int")
    out = neighbours.nearest(df, "id", "v", 16, **kw).collect()
    return {(r["key"], r["neighbour"]) for r in out}


def test_exact_with_one_part(spark):
    x = data()
    assert run(spark, x, k=3) == brute(x.astype(np.float32).astype(float), 3)


def test_parts_and_blocks_keep_recall(spark):
    x = data(1500, 400, 3)
    want = brute(x.astype(np.float32).astype(float), 3)
    got = run(spark, x, k=3, part_rows=150, probes=4, sample_rows=600, block_rows=60)
    assert len(got) == len(want)
    assert len(got & want) / len(want) > 0.9


def test_two_levels_keep_recall(spark):
    x = data(2400, 600, 5)
    want = brute(x.astype(np.float32).astype(float), 3)
    # Unrelated vectors have no near neighbours, so all three take more of the 30 parts ...
    got = run(spark, x, k=3, part_rows=60, probes=10, sample_rows=1200, most_regions=5)
    assert len(got) == len(want)
    assert len(got & want) / len(want) > 0.9
    # ... while truly similar ones are found with the usual five.
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {(a, b) for a, b in want if u[a] @ u[b] > 0.9}
    got = run(spark, x, k=3, part_rows=60, probes=5, sample_rows=1200, most_regions=5)
    assert len(got & near) / len(near) > 0.95


def test_routes_name_each_part_once():
    x = data(900, 0).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    routes = neighbours.Routes.fitted(x, 30, 6)
    best = routes.best(x, 5)
    assert best.max() < routes.begins[-1] and all(len(set(r)) == 5 for r in best.tolist())
    assert len(np.unique(best[:, 0])) > 15


def test_few_rows(spark):
    assert run(spark, np.zeros((0, 16))) == set()
    one = np.ones((1, 16))
    assert run(spark, one) == set()
    assert run(spark, np.ones((2, 16))) == {(0, 1), (1, 0)}


def test_balanced_parts():
    x = data(600, 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = neighbours.balanced_parts(neighbours.neighbour_graph(x, 5), x, 6)
    assert np.bincount(label, minlength=6).max() <= 110


def test_recall_with_many_parts(spark):
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(4000, 32)), 3, axis=0) + rng.normal(size=(12_000, 32)) * 0.3
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")
    found = neighbours.nearest(df, "id", "v", dim=32, k=2, part_rows=30)
    got = {(r["key"], r["neighbour"]) for r in found.where("similarity >= 0.9").collect()}
    want = set()
    for a in range(0, len(x), 1000):
        s = x[a : a + 1000] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        near = np.argpartition(-s, 1, axis=1)[:, :2]
        want |= {(a + i, int(j)) for i, j in zip(*np.nonzero(s >= 0.9)) if j in near[i]}
    assert len(got & want) >= 0.98 * len(want) > 4000


def test_probes_are_measured(spark):
    """Unrelated vectors, the hard case: as many parts are asked as the recall needs."""
    x = np.random.default_rng(3).normal(size=(6000, 16))
    want = brute(x.astype(np.float32).astype(float), 3, 9)
    for kw in ({"most_regions": 10}, {}):
        got = run(spark, x, k=3, part_rows=80, recall=0.97, **kw)
        assert len(got & want) / len(want) > 0.95


def test_all_parts_are_exact(spark):
    x = data(1500, 400, 4)
    got = run(spark, x, k=3, part_rows=100, probes=4096, sample_rows=600)
    assert got == brute(x.astype(np.float32).astype(float), 3)


def test_least_similarity(spark):
    x = data(1200, 300, 6)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a, b in brute(x.astype(np.float32).astype(float), 3) if u[a] @ u[b] >= 0.8}
    assert run(spark, x, k=3, least=0.8, part_rows=100, sample_rows=600) == want


class Task:
    """Stands for a table and keeps what would run in its tasks."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        raise StopIteration


def many_parts(rng, parts=400):
    u = lambda *size: rng.normal(size=size).astype(np.float32)
    return neighbours.Routes(neighbours.Router(u(64, 128), u(128), u(128, parts), u(parts)), [None] * parts, list(range(parts + 1)))


def unit_rows(rng, n):
    x = rng.normal(size=(n, 64)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_measuring_probes_takes_little_memory():
    """A task compares 10,000 rows with all held-out vectors, but not all at once."""
    rng = np.random.default_rng(8)
    x, queries, task, routes = unit_rows(rng, 10_000), unit_rows(rng, 1024), Task(), many_parts(rng)
    queries[:50] = x[-50:]  # these are the rows themselves
    names = pa.array([*range(9950, 10_000), *range(20_000, 20_974)], pa.int64())
    with contextlib.suppress(StopIteration):
        neighbours.probes_needed(task, routes, queries, names, 64, 3, -1.0, 0.999)
    batch = pa.record_batch([pa.array(range(10_000), pa.int64()), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["rep", "v"])
    tracemalloc.start()
    out = list(task.run(iter([batch])))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = queries @ x.T
    s[np.arange(50), np.arange(9950, 10_000)] = -2
    home = routes.best(x, 1)[:, 0]
    best = np.argsort(-s, axis=1)[:, :3]
    got = [sorted(zip(np.round(out["sim"].to_numpy()[own], 4).tolist(), out["part"].to_numpy()[own].tolist())) for q in range(1024) for own in [out["q"].to_numpy() == q]]
    assert got == [sorted(zip(np.round(s[q, b].astype(float), 4).tolist(), home[b].tolist())) for q, b in enumerate(best)]
    assert peak < 150e6


def test_rows_are_sent_in_small_batches():
    """Every base meets every row that asks its part once, whatever the blocks."""
    rng = np.random.default_rng(9)
    x, routes = unit_rows(rng, 3000), many_parts(rng, 6)
    base, query = np.array([1, 2, 1, 3, 1, 2]), np.array([1, 3, 2, 1, 1, 4])
    salt = rng.integers(-(1 << 40), 1 << 40, 3000)
    batch = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(x.tolist(), pa.list_(pa.float32())), pa.array(salt)], names=["rep", "v", "salt"])
    sent = list(neighbours.sent_to_parts(iter([batch]), routes, 4, 64, base, query))
    assert max(b.num_rows for b in sent) <= 8192 < sum(b.num_rows for b in sent)
    got = sorted(r for b in sent for r in zip(*(b[c].to_pylist() for c in ("rep", "part", "b", "q", "role"))))
    want = []
    for i, order in enumerate(routes.best(x, 4).tolist()):
        for p in order:
            one = base[p] == query[p] == 1
            if p == order[0] and not one:
                want += [(i, p, salt[i] % base[p], q, 1) for q in range(query[p])]
            want += [(i, p, b, salt[i] % query[p], 3 if one and p == order[0] else 2) for b in range(base[p])]
    assert got == sorted(want)
    sizes = list(neighbours.part_sizes(iter([batch]), routes, 4, 64, 6))[0].to_pydict()
    asked = routes.best(x, 4)
    assert sizes == {"part": list(range(6)), "queries": np.bincount(asked.ravel(), minlength=6).tolist(), "homes": np.bincount(asked[:, 0], minlength=6).tolist()}
