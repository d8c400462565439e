"""Cutting long token sequences into overlapping pieces by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm._arrow import lengths, starts


def piece_bounds(natural: np.ndarray, lens: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, begin, end) of the pieces of many sequences at once.

    ``natural[p]`` tells that a cut right after token ``p`` of the concatenated
    sequences is natural.  The successor table holds, for every possible piece begin,
    the begin of the next piece; joining the table with itself doubles the number of
    steps it takes, so all begins reachable from the sequences' starts are known after
    log2(pieces) rounds.
    """
    assert 0 <= overlap < limit
    total = int(lens.sum())
    begin0 = starts(lens)
    seq = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(total, dtype=np.int64)
    stop = (begin0 + lens)[seq]
    # The last natural cut at or before each position, as the position after its token.
    cut = np.concatenate([[0], np.maximum.accumulate(np.where(natural, at + 1, 0))])
    full = np.minimum(at + limit, stop)
    end = np.where(cut[full] > at + overlap, cut[full], full)
    end = np.where(stop - at <= limit, stop, end)
    following = np.where(end < stop, end - overlap, at)
    reached = np.zeros(total, bool)
    reached[begin0[lens > 0]] = True
    for _ in range(int(np.ceil(np.log2(lens.max(initial=1) + 1))) + 1):
        found = following[reached]
        if reached[found].all():
            break
        reached[found] = True
        following = following[following]
    p = np.flatnonzero(reached)
    return seq[p], p - begin0[seq[p]], end[p] - begin0[seq[p]]


def split_long(df: DataFrame, key: str, words: str, enders: DataFrame, limit: int = 128, overlap: int = 16, most_enders: int = 100_000) -> DataFrame:
    """Pieces ``[begin, end)`` of every sequence of more than ``limit`` words.

    ``enders`` has one column of the word ids after which a cut is natural.  The first
    piece begins at 0.  While more than ``limit`` words remain, a piece ends after the
    last natural cut that leaves it at most ``limit`` and more than ``overlap`` words,
    or after ``limit`` words if there is none, and the next begins ``overlap`` words
    before that end; otherwise it ends with the sequence.

    Rows with null key or null words and short sequences give nothing; null words inside
    a sequence are ordinary words that end nothing.  Rows that repeat a key count once,
    with the longest (then greatest) sequence.  Result: (key, begin, end).

    Sequences are cut whole, many of them in one vectorised pass.  The natural cuts come
    as a literal list while there are at most ``most_enders``; beyond that they are
    marked by a join.
    """
    long = df.where(F.col(key).isNotNull() & (F.size(words) > limit)).select(F.col(key).alias("key"), F.col(words).alias("words"))
    # Map-side, a hot key shrinks to one row a task before anything is shuffled.
    one = long.groupBy("key").agg(F.max(F.struct(F.size("words").alias("n"), F.col("words").alias("w"))).alias("s")).select("key", F.col("s.w").alias("words"))
    ids = enders.toDF("word").where("word is not null").distinct()
    known = [r[0] for r in ids.limit(most_enders + 1).collect()]
    if len(known) > most_enders:
        flat = one.select("key", F.posexplode("words").alias("pos", "word"))
        marked = flat.join(ids.withColumn("ends", F.lit(1)), "word", "left").groupBy("key")
        one = marked.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ends", F.lit(0)).alias("e")))), lambda x: x["e"].cast("bigint")).alias("words"))
        known = [1]
    ending = np.array(sorted(known), dtype=np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lens = lengths(batch.column(1))
            flat = pc.list_flatten(batch.column(1))
            natural = np.isin(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False), ending) & pc.is_valid(flat).to_numpy(zero_copy_only=False)
            seq, begin, end = piece_bounds(natural, lens, limit, overlap)
            yield pa.record_batch([batch.column(0).take(pa.array(seq)), pa.array(begin), pa.array(end)], names=["key", "begin", "end"])

    kind = one.schema["key"].dataType.simpleString()
    return one.mapInArrow(cut, f"key {kind}, begin bigint, end bigint")
