"""The nearest vectors of every vector, by learned partitions.

On a bounded sample the neighbour graph is made and cut into balanced parts that cut few
of its edges.  A small network learns to tell a vector's part from the vector; it gives
every vector a home part, and sends it as a query to its most probable parts, where it is
compared with all that live there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.llm._spark import checkpointed, hash_sample

#: Rows that a task scores, and that it sends on, at once: its arrays grow with nothing else.
_SCORED, _SENT = 1024, 8192


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of every unit row of ``x``, (rows, k)."""
    out = np.empty((len(x), k), np.int64)
    step = max(1, min(512, (1 << 22) // max(1, len(x))))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + step] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Part of every node, none above ``slack`` times the mean, few edges cut.

    Starts from balanced halvings along the main direction of each half, then moves nodes
    to the part that holds most of their neighbours while there is room.
    """
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            label[rows] = first
            continue
        own = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(own.T @ own)[1][:, -1]
        left = n // 2
        at = np.argsort(own @ direction, kind="stable")
        cut = len(rows) * left // n
        todo += [(rows[at[:cut]], first, left), (rows[at[cut:]], first + left, n - left)]
    most = math.ceil(slack * len(x) / parts)
    size = np.bincount(label, minlength=parts)
    both = [list(g) for g in graph]
    for i, g in enumerate(graph):
        for j in g:
            both[j].append(i)
    both = [np.array(b) for b in both]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            near = np.bincount(label[both[i]], minlength=parts)
            near[size >= most] = -1
            here = label[i]
            near[here] = np.count_nonzero(label[both[i]] == here)
            best = int(near.argmax())
            if near[best] > near[here]:
                size[here] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


class Router:
    """A network of one hidden layer that gives the probabilities of the parts."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray):
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fitted(cls, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, batch: int = 256, rate: float = 3e-3, seed: int = 7) -> Router:
        """Adam on the cross entropy to ``target``, the share of a vector and its
        neighbours in each part."""
        rng = np.random.default_rng(seed)
        dim, parts = x.shape[1], target.shape[1]
        p = [rng.normal(0, math.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(2 / hidden), (hidden, parts)), np.zeros(parts)]
        p = [a.astype(np.float32) for a in p]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            lr = rate * (1 - epoch / epochs)
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                xb, tb = x[rows], target[rows]
                h = xb @ p[0] + p[1]
                act = np.maximum(h, 0)
                z = act @ p[2] + p[3]
                z = np.exp(z - z.max(1, keepdims=True))
                dz = (z / z.sum(1, keepdims=True) - tb) / len(rows)
                dh = (dz @ p[2].T) * (h > 0)
                grads = [xb.T @ dh, dh.sum(0), act.T @ dz, dz.sum(0)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return cls(*(a.astype(np.float32) for a in p))


def learned_router(x: np.ndarray, parts: int, near: int = 10) -> Router:
    near = max(1, min(near, len(x) - 1))
    graph = neighbour_graph(x, near)
    label = balanced_parts(graph, x, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.arange(len(x)), label), 0.5)
    np.add.at(target, (np.repeat(np.arange(len(x)), near), label[graph].ravel()), 0.5 / near)
    return Router.fitted(x.astype(np.float32), target)


def _log_shares(logits: np.ndarray) -> np.ndarray:
    z = logits - logits.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


class Routes:
    """Routers in one or two levels: the first tells the region, that of a region its part.

    Two levels keep every network small and every part's share of the sample useful when
    there are many parts.
    """

    def __init__(self, first: Router, regions: list[Router | None], begins: list[int]):
        self.first, self.regions, self.begins = first, regions, begins

    @classmethod
    def fitted(cls, x: np.ndarray, parts: int, most_regions: int = 64) -> Routes:
        if parts <= most_regions:
            return cls(learned_router(x, parts), [None] * parts, list(range(parts + 1)))
        regions = min(most_regions, math.isqrt(parts))
        first = learned_router(x, regions)
        home = first.logits(x).argmax(1)
        routers: list[Router | None] = []
        begins = [0]
        for r in range(regions):
            own = x[home == r]
            # A region gets parts by its share of the sample, if that is enough to learn from.
            n = max(1, round(parts * len(own) / len(x)))
            n = n if len(own) >= 8 * n else max(1, len(own) // 8)
            routers.append(learned_router(own, n) if n > 1 else None)
            begins.append(begins[-1] + n)
        return cls(first, routers, begins)

    def best(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable parts of every row, the most probable first; -1
        where the regions asked have fewer."""
        near = _log_shares(self.first.logits(x))
        if all(r is None for r in self.regions):
            return np.argsort(-near, axis=1, kind="stable")[:, :probes]
        asked = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        out = np.full((len(x), probes), -1)
        shares = np.full((len(x), probes), -np.inf)
        for r, router in enumerate(self.regions):
            rows = np.flatnonzero((asked == r).any(1))
            if not len(rows):
                continue
            inner = _log_shares(router.logits(x[rows])) if router is not None else np.zeros((len(rows), 1))
            parts = np.broadcast_to(np.arange(self.begins[r], self.begins[r + 1]), inner.shape)
            every = np.concatenate([shares[rows], inner + near[rows, r : r + 1]], axis=1)
            names = np.concatenate([out[rows], parts], axis=1)
            top = np.argsort(-every, axis=1, kind="stable")[:, :probes]
            shares[rows] = np.take_along_axis(every, top, axis=1)
            out[rows] = np.take_along_axis(names, top, axis=1)
        return out


def _matrix(column, dim: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vector: Column, dim: int) -> Column:
    """True for vectors of ``dim`` finite numbers that are not all zero."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & good & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(
    df: DataFrame,
    key: str,
    vector: str,
    dim: int,
    k: int = 3,
    least: float = -1.0,
    probes: int | None = None,
    recall: float = 0.999,
    part_rows: int = 1500,
    most_parts: int = 4096,
    sample_rows: int = 8000,
    most_sample_rows: int = 65_536,
    most_regions: int = 512,
    block_rows: int = 6000,
    held_out: int = 1024,
) -> DataFrame:
    """The ``k`` most similar other vectors of every vector, by cosine, of those with a
    cosine of ``least``.

    The higher cosine goes first, then the smaller key.  Rows with a null key or without
    ``dim`` finite numbers that are not all zero take no part; rows that repeat a key
    count once, with the smallest vector.  Fewer than k + 1 vectors give fewer
    neighbours, an empty table none.  Result: (key, neighbour, similarity).

    The routers are fitted on the vectors of smallest hash, a bounded sample of
    ``sample_rows`` or 84 for each part, ``most_sample_rows`` at most; every vector is
    indexed and every vector is a query, in its ``probes`` most probable of about rows /
    ``part_rows`` parts (at most ``most_parts``; over ``most_regions`` in two levels).
    Where ``probes`` isn't given, it is measured: for ``held_out`` more vectors of the
    sample, which no router was fitted on, the true neighbours among all vectors are
    found, and as many parts are asked as reach ``recall`` of them.  ``probes`` of
    ``most_parts`` asks all parts and is exact.
    Vectors that
    are equal are searched once and get their neighbours back at the end, so copies don't
    fill a part; a part that is large all the same is compared in blocks of
    ``block_rows``, all blocks with all, each a task's bounded work.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector), dim)).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    whole = rows.groupBy("key").agg(F.min("v").alias("v")).select("key", "v", F.array(length).alias("n"))
    # The length is bound in a lambda, so it isn't computed again for every number.
    unit = F.get(F.transform("n", lambda n: F.transform("v", lambda x: (x / n).cast("float"))), 0)
    one = whole.select("key", unit.alias("v"))
    # Equal vectors are one class, known by two hashes.
    kept = one.select("key", "v", F.xxhash64("v").alias("c1"), F.xxhash64(F.lit(1), "v", F.lit(2)).alias("c2"))
    cut = checkpointed(kept)
    classes = cut.groupBy("c1", "c2").agg(F.first("v").alias("v"), F.min("key").alias("rep"))
    first_ones = Window.partitionBy("c1", "c2").orderBy("key")
    heads = cut.select("c1", "c2", "key").withColumn("r", F.row_number().over(first_ones)).where(F.col("r") <= k + 1)
    heads = heads.groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.sort_array(F.collect_list("key")).alias("ids"))
    by_rep = _search(classes.select("rep", "v"), kind, dim, k, least, probes, recall, part_rows, most_parts, sample_rows, most_sample_rows, most_regions, block_rows, held_out)
    # Back to all members: a class's candidates are its own heads and those of its neighbours.
    ids = heads.select("rep", "ids")
    of_near = by_rep.join(ids.withColumnsRenamed({"rep": "near", "ids": "near_ids"}), "near").select("rep", "sim", F.explode(F.slice("near_ids", 1, k)).alias("id"))
    of_own = ids.where(F.size("ids") > 1).select("rep", F.lit(1.0).alias("sim"), F.explode("ids").alias("id"))
    offers = of_near.unionByName(of_own).groupBy("rep").agg(F.collect_list(F.struct("id", "sim")).alias("offers"))
    members = cut.select("key", "c1", "c2").join(heads.select("c1", "c2", "rep"), ["c1", "c2"]).select("key", "rep")
    open_rows = members.join(offers, "rep").select("key", F.filter("offers", lambda o: o["id"] != F.col("key")).alias("offers"))
    best = F.slice(F.array_sort("offers", lambda a, b: F.when(a["sim"] > b["sim"], -1).when(a["sim"] < b["sim"], 1).when(a["id"] < b["id"], -1).otherwise(1)), 1, k)
    return open_rows.select("key", F.explode(best).alias("o")).select("key", F.col("o.id").alias("neighbour"), F.col("o.sim").alias("similarity"))


def nearest_homes(batches: Iterator[pa.RecordBatch], routes: Routes, queries: np.ndarray, names: pa.Array, dim: int, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """(q, part, sim): similarity and home part of the ``k`` nearest to every query among
    the rows (rep, v); ``names`` are the queries' own, which don't count."""
    n = len(queries)
    q, sim, home = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
    bound = np.full(n, least, np.float32)
    for batch in batches:
        for a in range(0, batch.num_rows, _SCORED):
            part = batch.slice(a, _SCORED)
            x = _matrix(part.column(1), dim)
            s = queries @ x.T
            at = pc.fill_null(pc.index_in(part.column(0), names), -1).to_numpy()
            own = np.flatnonzero(at >= 0)
            s[at[own], own] = -2
            near_q, row = np.nonzero(s >= bound[:, None])
            if not len(row):
                continue
            # Only rows that are near to a query are routed.
            rows, row_at = np.unique(row, return_inverse=True)
            q, sim = np.concatenate([q, near_q]), np.concatenate([sim, s[near_q, row]])
            home = np.concatenate([home, routes.best(x[rows], 1)[row_at, 0]])
            order = np.lexsort((-sim, q))
            q, sim, home = q[order], sim[order], home[order]
            first = np.searchsorted(q, np.arange(n))
            keep = np.arange(len(q)) - first[q] < k
            q, sim, home = q[keep], sim[keep], home[keep]
            full = np.flatnonzero(np.bincount(q, minlength=n) == k)
            bound[full] = sim[np.searchsorted(q, full, side="right") - 1]
    yield pa.record_batch([pa.array(q), pa.array(home), pa.array(sim.astype(np.float64))], names=["q", "part", "sim"])


def probes_needed(table: DataFrame, routes: Routes, queries: np.ndarray, names: pa.Array, dim: int, k: int, least: float, recall: float) -> int:
    """How many parts must be asked to reach ``recall`` of the true neighbours of queries.

    One pass over the table compares all vectors with the queries, a bounded number; each
    task keeps the ``k`` best of every query, and the home parts of these come out.
    """
    parts = routes.begins[-1]

    def scan(batches):
        return nearest_homes(batches, routes, queries, names, dim, k, least)

    found = table.select("rep", "v").mapInArrow(scan, "q bigint, part bigint, sim double")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "part")
    true = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "part").toArrow()
    if not true.num_rows:
        return 1
    asking, meant = true["q"].to_numpy(), true["part"].to_numpy()
    ranks = np.empty(len(asking), np.int64)
    for a in range(0, len(queries), 128):
        own = np.flatnonzero((asking >= a) & (asking < a + 128))
        where = routes.best(queries[a : a + 128], parts)[asking[own] - a] == meant[own, None]
        ranks[own] = np.where(where.any(1), where.argmax(1), parts - 1)
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _asked_parts(batches: Iterator[pa.RecordBatch], routes: Routes | None, asked: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of the batches (rep, v, ...), and for each part that a row of theirs asks
    the row's number, the part and whether it is the row's home."""
    for batch in batches:
        for a in range(0, batch.num_rows, _SCORED):
            rows = batch.slice(a, _SCORED)
            order = np.zeros((rows.num_rows, 1), np.int64) if routes is None else routes.best(_matrix(rows.column(1), dim), asked)
            row, rank = np.nonzero(order >= 0)
            yield rows, row, order[row, rank], rank == 0


def part_sizes(batches: Iterator[pa.RecordBatch], routes: Routes | None, asked: int, dim: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, queries, homes): how many rows (rep, v) ask a part and live there."""
    queries, homes = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    for _, _, part, home in _asked_parts(batches, routes, asked, dim):
        queries += np.bincount(part, minlength=parts)
        homes += np.bincount(part[home], minlength=parts)
    some = np.flatnonzero(queries)
    yield pa.record_batch([pa.array(some), pa.array(queries[some]), pa.array(homes[some])], names=["part", "queries", "homes"])


def sent_to_parts(batches: Iterator[pa.RecordBatch], routes: Routes | None, asked: int, dim: int, base_blocks: np.ndarray, query_blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (rep, v, salt) for the comparisons (part, b, q): as bases (role 1) in their
    home, as queries (2) in the parts they ask, or both (3).

    A base lies in one block b and meets all blocks q of queries, a query the reverse.
    Where a part is one block, its members are bases and queries in one row.
    """
    for rows, row, part, home in _asked_parts(batches, routes, asked, dim):
        salt = rows.column(2).to_numpy()[row]
        bases, queries = base_blocks[part], query_blocks[part]
        single = (bases == 1) & (queries == 1)
        # Copies of a row: in its home one for each block of queries, as a query one for each block of bases.
        as_base = np.where(home & ~single, queries, 0)
        n = as_base + bases
        begin = np.cumsum(n) - n
        for a in range(0, int(n.sum()), _SENT):
            copy = np.arange(a, min(a + _SENT, int(n.sum())))
            i = np.searchsorted(begin, copy, side="right") - 1
            c = copy - begin[i]
            base = c < as_base[i]
            b = np.where(base, salt[i] % bases[i], c - as_base[i])
            q = np.where(base, c, salt[i] % queries[i])
            role = np.where(base, 1, np.where(home[i] & single[i], 3, 2))
            at = pa.array(row[i])
            yield pa.record_batch([rows.column(0).take(at), rows.column(1).take(at), pa.array(part[i]), pa.array(b.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(role.astype(np.int8))], names=["rep", "v", "part", "b", "q", "role"])


def _search(vectors: DataFrame, kind: str, dim: int, k: int, least: float, probes: int | None, recall: float, part_rows: int, most_parts: int, sample_rows: int, most_sample_rows: int, most_regions: int, block_rows: int, held_out: int) -> DataFrame:
    """(rep, near, sim): the k nearest of every distinct vector."""
    table = checkpointed(vectors.select("rep", "v"))
    n = table.count()
    parts = max(1, min(most_parts, round(n / part_rows)))
    routes, asked = None, 1
    if parts > 1:
        fitting = min(most_sample_rows, max(sample_rows, 84 * parts))
        taken = hash_sample(table, fitting + held_out).toArrow()
        # At least four fifths of a small table's sample are for fitting.
        fitting = min(fitting, taken.num_rows * 4 // 5)
        x = _matrix(taken["v"].combine_chunks(), dim)
        routes = Routes.fitted(x[:fitting], parts, most_regions)
        parts = routes.begins[-1]
        asked = min(probes, parts) if probes else probes_needed(table, routes, x[fitting:], taken["rep"][fitting:].combine_chunks(), dim, k, least, recall)

    def count(batches):
        return part_sizes(batches, routes, asked, dim, parts)

    # Sizes of the parts, at most ``most_parts`` rows, tell how many blocks they need.
    counted = table.mapInArrow(count, "part bigint, queries bigint, homes bigint").groupBy("part").agg(F.sum("queries").alias("queries"), F.sum("homes").alias("homes"))
    base_blocks, query_blocks = np.ones(parts, np.int64), np.ones(parts, np.int64)
    for r in counted.collect():
        base_blocks[r["part"]] = max(1, -(-r["homes"] // block_rows))
        query_blocks[r["part"]] = max(1, -(-r["queries"] // block_rows))

    def send(batches):
        return sent_to_parts(batches, routes, asked, dim, base_blocks, query_blocks)

    def compare(group: pa.Table) -> pa.Table:
        role = group["role"].to_numpy()
        x = _matrix(group["v"].combine_chunks(), dim).astype(np.float64)
        names = group["rep"].combine_chunks()
        base_at, query_at = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        # Bases in order of their names: a stable sort then resolves equal cosines.
        base_at = base_at[pc.sort_indices(names.take(pa.array(base_at))).to_numpy()]
        base, base_names = x[base_at], names.take(pa.array(base_at))
        out_q, out_b, out_s = [], [], []
        for a in range(0, len(query_at), 256):
            rows = query_at[a : a + 256]
            s = np.round(x[rows] @ base.T, 9) if len(base) else np.zeros((len(rows), 0))
            same = pc.index_in(names.take(pa.array(rows)), base_names)
            itself = pc.fill_null(same, -1).to_numpy()
            has = itself >= 0
            s[np.flatnonzero(has), itself[has]] = -9
            take = min(k, s.shape[1])
            if not take:
                continue
            bound = -np.partition(-s, take - 1, axis=1)[:, take - 1 : take]
            qi, bi = np.nonzero(s >= np.maximum(bound, max(least, -2.0)))
            v = s[qi, bi]
            order = np.lexsort((bi, -v, qi))
            qi, bi, v = qi[order], bi[order], v[order]
            start = np.searchsorted(qi, np.arange(len(rows)))
            keep = np.arange(len(qi)) - start[qi] < k
            out_q.append(rows[qi[keep]])
            out_b.append(base_at[bi[keep]])
            out_s.append(v[keep])
        q, b, v = (np.concatenate(o) if o else np.zeros(0, t) for o, t in ((out_q, np.int64), (out_b, np.int64), (out_s, float)))
        return pa.table({"rep": names.take(pa.array(q)), "near": names.take(pa.array(b)), "sim": pa.array(v, pa.float64())})

    sent = table.select("rep", "v", F.xxhash64("rep").alias("salt")).mapInArrow(send, f"rep {kind}, v array<float>, part bigint, b int, q int, role byte")
    found = sent.groupBy("part", "b", "q").applyInArrow(compare, f"rep {kind}, near {kind}, sim double")
    order = Window.partitionBy("rep").orderBy(F.desc("sim"), "near")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
