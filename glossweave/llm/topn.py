"""Strongest items of every group, kept in bounded heaps that merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glossweave.llm._arrow import ints, lengths, ranges, starts, text_codes, unchunk

SCHEMA = pa.schema([("key", pa.string()), ("slot", pa.int64()), ("item", pa.int64()), ("score", pa.float64())])


def _kept(key: np.ndarray, slot: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Rows that stay in the heaps: of each (key, slot) the ``n`` best distinct items.

    An item counts with its highest score; the higher score goes first, then the
    smaller item.  Cutting to ``n`` distinct items keeps the operation mergeable: an
    item of the final ``n`` has fewer than ``n`` better ones in any part of the data
    that holds its highest score.
    """
    order = np.lexsort((item, -score, slot, key))
    k, s, i = key[order], slot[order], item[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    # The first row of an item in its group has its highest score.
    by_item = np.lexsort((np.arange(len(order)), i, group))
    first = np.ones(len(order), bool)
    first[1:] = (group[by_item][1:] != group[by_item][:-1]) | (i[by_item][1:] != i[by_item][:-1])
    best = np.zeros(len(order), bool)
    best[by_item[first]] = True
    seen = np.cumsum(best)
    before = np.where(new, seen - best, 0)
    before = np.maximum.accumulate(before)
    return order[best & (seen - before <= n)]


def _compact(heaps: pa.Table, n: int) -> pa.Table:
    heaps = heaps.combine_chunks()
    if not heaps.num_rows:
        return heaps
    _, key = text_codes(heaps["key"])
    item, slot = heaps["item"].to_numpy(), heaps["slot"].to_numpy()
    return heaps.take(pa.array(_kept(key, slot, item, heaps["score"].to_numpy(), n)))


def _offers(batch: pa.RecordBatch, unknown: int) -> pa.Table:
    """(key, slot, item, score) of every item that counts in a batch of nested rows."""
    keys, begins, items, scores = (batch.column(i) for i in range(4))
    n_begin, n_items, n_scores = lengths(begins), lengths(items), lengths(scores)
    inner_items, inner_scores = pc.list_flatten(items), pc.list_flatten(scores)
    begin, begin_there = ints(pc.list_flatten(begins))
    item, item_there = ints(pc.list_flatten(inner_items), unknown)
    score = pc.fill_null(pc.list_flatten(inner_scores), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    len_items, len_scores = lengths(inner_items), lengths(inner_scores)
    # Spans: the j-th begin, item list and score list of a row belong together.
    row, j = np.repeat(np.arange(batch.num_rows), n_items), ranges(n_items)
    there = (j < n_begin[row]) & (j < n_scores[row])
    at_begin = np.where(there, starts(n_begin)[row] + j, 0)
    at_score = np.where(there, starts(n_scores)[row] + j, 0)
    if len(begin) and len(len_scores):
        there &= begin_there[at_begin]
        score_len, score_start = np.where(there, len_scores[at_score], 0), starts(len_scores)[at_score]
    else:
        there[:] = False
        score_len = score_start = np.zeros(len(row), np.int64)
    there &= pc.is_valid(keys).to_numpy(zero_copy_only=False)[row]
    # Items of the spans: the k-th item and score belong together.
    span, k = np.repeat(np.arange(len(row)), len_items), ranges(len_items)
    good = there[span] & (k < score_len[span]) & item_there & (item != unknown)
    span, k, item = span[good], k[good], item[good]
    value = score[score_start[span] + k] if len(score) else np.zeros(0)
    good = ~np.isnan(value)
    span, item, value = span[good], item[good], value[good]
    slot = begin[at_begin[span]] if len(begin) else np.zeros(0, np.int64)
    key = keys.take(pa.array(row[span])) if batch.num_rows else pa.array([], pa.string())
    return pa.table([unchunk(key), slot.astype(np.int64), item.astype(np.int64), value], schema=SCHEMA)


class _Bounds:
    """The last of every full heap: what comes behind it cannot get in."""

    def __init__(self, heaps: pa.Table, n: int):
        # Heaps lie in order of their groups, the best first.
        names, key = text_codes(heaps["key"])
        slot = heaps["slot"].to_numpy()
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(key)])
        last = first[size >= n] + n - 1
        last = last[(slot[last] >= 0) & (slot[last] < 1 << 32)]
        self.names, group = names, (key[last] << 32) | slot[last]
        order = np.argsort(group)
        self.group = group[order]
        self.item, self.score = (heaps[c].to_numpy()[last[order]] for c in ("item", "score"))

    def above(self, offers: pa.Table) -> pa.Table:
        if not len(self.group) or not offers.num_rows:
            return offers
        key = pc.fill_null(pc.index_in(offers["key"], self.names), -1).to_numpy().astype(np.int64)
        slot, item, score = (offers[c].to_numpy() for c in ("slot", "item", "score"))
        group = np.where((key >= 0) & (slot >= 0) & (slot < 1 << 32), (key << 32) | slot, -1)
        at = np.minimum(np.searchsorted(self.group, group), len(self.group) - 1)
        behind = (score < self.score[at]) | ((score == self.score[at]) & (item > self.item[at]))
        return offers.filter(pa.array((self.group[at] != group) | ~behind))


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=65_536)


def strongest(df: DataFrame, key: str, slots: str, items: str, scores: str, n: int = 5, unknown: int = 0, buffer_rows: int = 500_000) -> DataFrame:
    """The ``n`` best items of every (key, slot) over all rows.

    ``slots`` is a list per row; ``items`` and ``scores`` hold one list for each slot.
    Item and score belong together by position; positions missing in either list, null
    and NaN scores, null items, the item ``unknown``, null keys and null slots do not
    count.  An item has its highest score in the group; ties go to the smaller item.
    Empty tables and groups without counting items give no rows; other columns are
    ignored.  Result: (key, slot, item, score).

    Each task keeps heaps of at most ``n`` items a group, into which an item behind the
    last of a full one doesn't get, and hands them on when they reach ``buffer_rows`` rows
    in all, so that before the shuffle a hot group shrinks to
    ``n`` rows a task; after it the heaps of a group arrive together, in order, and are
    merged as they stream by.
    """
    names = [f.name for f in df.schema.fields]
    assert all(c in names for c in (key, slots, items, scores))
    kind = {f.name: f.dataType for f in df.schema.fields}[scores]
    assert isinstance(kind, T.ArrayType)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, bounds = SCHEMA.empty_table(), None
        waiting, rows = [], 0
        for batch in batches:
            offers = _offers(batch, unknown)
            waiting.append(bounds.above(offers) if bounds else offers)
            rows += waiting[-1].num_rows
            # Heaps are put in order as often as they double at most.
            if rows >= max(100_000, heaps.num_rows):
                heaps, waiting, rows = _compact(pa.concat_tables([heaps, *waiting]), n), [], 0
                if heaps.num_rows > buffer_rows:
                    yield from _batches(heaps)
                    heaps = SCHEMA.empty_table()
                bounds = _Bounds(heaps, n)
        yield from _batches(_compact(pa.concat_tables([heaps, *waiting]), n))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_heaps = SCHEMA.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            heaps = _compact(pa.concat_tables([open_heaps, pa.Table.from_batches([batch]).cast(SCHEMA)]), n)
            # The last group may go on in the next batch.
            last = batch.num_rows - 1
            same = pc.and_(pc.equal(heaps["key"], batch.column(0)[last]), pc.equal(heaps["slot"], batch.column(1)[last]))
            open_heaps = heaps.filter(same)
            yield from _batches(heaps.filter(pc.invert(same)))
        yield from _batches(open_heaps)

    schema = "key string, slot bigint, item bigint, score double"
    built = df.select(key, slots, items, scores).mapInArrow(build, schema)
    return built.repartition("key", "slot").sortWithinPartitions("key", "slot").mapInArrow(merge, schema)
