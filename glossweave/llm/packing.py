"""Packing items of varying length into containers of fixed capacity."""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _encoder(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, ranks_path: str, out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of ``text``; null and blank texts have none."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(ranks_path).encode_ordinary
        return pd.Series([0 if t is None or not t.strip() else len(encode(t)) for t in texts], dtype="int64")

    return df.withColumn(out, count(F.col(text)))


class SumOfSquares:
    """Online packing by the sum-of-squares rule.

    ``level[h]`` is the number of open containers filled to ``h``.  An item goes to the
    level (0: a new container) that leaves the sum of the squared counts smallest; of
    equal choices the fullest container wins.  A full container is no longer counted.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def place(self, size: int) -> tuple[int, int]:
        """Container of an item of 1..capacity and where in it the item begins."""
        top = self.capacity - size
        # Change of the sum: level h loses one container, level h + size gains one.
        change = 2 * (self.level[size : self.capacity + 1] - self.level[: top + 1]) + 2
        change[0] = 2 * self.level[size] + 1
        # Filling a container takes it out of the sum.
        change[top] = 0 if top == 0 else 1 - 2 * self.level[top]
        possible = self.level[: top + 1] > 0
        possible[0] = True
        change = np.where(possible, change, np.iinfo(np.int64).max)
        h = top - int(np.argmin(change[::-1]))
        if h:
            container = self.open[h].pop()
            self.level[h] -= 1
        else:
            container = self.containers
            self.containers += 1
        if h + size < self.capacity:
            self.open[h + size].append(container)
            self.level[h + size] += 1
        return container, h


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece begin, piece size, container, place in it) of items of any size.

    Only an item above the capacity is cut: into full containers and a rest.
    """
    whole, rest = sizes // capacity, sizes % capacity
    item, begin, size, container, place = [], [], [], [], []
    rule = SumOfSquares(capacity)
    for i in np.flatnonzero(sizes > 0):
        for w in range(int(whole[i])):
            item.append(i), begin.append(w * capacity), size.append(capacity), container.append(rule.containers), place.append(0)
            rule.containers += 1
        if rest[i]:
            c, at = rule.place(int(rest[i]))
            item.append(i), begin.append(int(whole[i]) * capacity), size.append(int(rest[i])), container.append(c), place.append(at)
    return tuple(np.array(x, np.int64) for x in (item, begin, size, container, place))


def packed(df: DataFrame, key: str, size: str, capacity: int = 2048, items_a_packer: int = 100_000) -> DataFrame:
    """Every item of ``df`` with its container.

    Result: (key, piece_begin, piece_size, container, place), one row for every piece; a
    piece is a whole item unless the item alone exceeds ``capacity``.  Items of null or
    no size get one row without container.  Repeated rows are items of their own; a null
    key is a key like any other; an empty table gives no rows.  ``container`` is unique
    over all packers.

    Sizes are known before the packing, so only (key, size) moves.  Items are dealt by
    key to packers of about ``items_a_packer`` each, which pack in order of the key: one
    packer leaves at most its few open containers unfilled, whatever the corpus' size.
    """
    rows = df.select(F.col(key).alias("key"), F.greatest(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    packers = max(1, math.ceil(rows.count() / items_a_packer))
    kind = df.schema[key].dataType.simpleString()
    if packers == 1:
        dealt = rows.withColumn("packer", F.lit(0).cast("bigint"))
    else:
        # Equal rows are told apart by number alone, so they are dealt the same way however
        # the rows are laid out; their number comes out of two short lists.
        alike = rows.groupBy("key", "size").agg(F.count("*").alias("n"))
        tens = alike.select("key", "size", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 10_000))).alias("t"))
        each = tens.select("key", "size", F.explode(F.sequence(F.col("t") * 10_000, F.least(F.col("t") * 10_000 + 9_999, F.col("n") - 1))).alias("i"))
        dealt = each.select("key", "size", F.pmod(F.xxhash64("key", "size", "i"), F.lit(packers)).alias("packer"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("key", "ascending"), ("size", "ascending")]))
        sizes = np.maximum(pc.fill_null(table["size"], 0).to_numpy(), 0)
        item, begin, part, container, place = pack_sizes(sizes, capacity)
        none = np.flatnonzero(sizes == 0)
        first = int(table["packer"][0].as_py()) << 40
        empty = pa.nulls(len(none), pa.int64())
        return pa.table(
            {
                "key": table["key"].take(pa.array(np.concatenate([item, none]))),
                "piece_begin": np.concatenate([begin, np.zeros(len(none), np.int64)]),
                "piece_size": np.concatenate([part, np.zeros(len(none), np.int64)]),
                "container": pa.chunked_array([pa.array(container + first), empty]),
                "place": pa.chunked_array([pa.array(place), empty]),
            }
        )

    return dealt.groupBy("packer").applyInArrow(pack, f"key {kind}, piece_begin bigint, piece_size bigint, container bigint, place bigint")


def packed_texts(df: DataFrame, key: str, text: str, ranks_path: str, capacity: int = 2048, items_a_packer: int = 100_000) -> DataFrame:
    """``packed`` over texts sized in tokens of the tokenizer at ``ranks_path``."""
    sized = with_token_counts(df.select(key, text), text, ranks_path).select(key, "n_tokens")
    return packed(sized, key, "n_tokens", capacity, items_a_packer)

