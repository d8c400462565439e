"""Cutting lineage by checkpoints in a folder all executors share; sampling; broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the session's checkpoint folder.

    The folder is that of ``spark.checkpoint.dir``.  Where it is unset and the session
    runs on this machine alone, as in tests, a temporary one is made; a cluster without
    such a folder is an error, as its machines don't see each other's.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="glossweave-checkpoints-")
        context.setCheckpointDir(named)
    return df.checkpoint()


def hash_sample(df: DataFrame, rows: int) -> DataFrame:
    """Up to ``rows`` distinct rows of smallest content hash.

    A bound on the hash, taken from about how many distinct rows there are, keeps all but
    about twice the sample in the tasks, so that what reaches the driver is bounded
    whatever their number.  Rows that repeat count once, so no copies fill the sample;
    equal hashes are ordered by content, so it is the same in every run.
    """
    span = 1 << 62
    h = F.pmod(F.xxhash64(*df.columns), F.lit(span))
    n = df.agg(F.approx_count_distinct(F.xxhash64(*df.columns), 0.02)).first()[0]
    if n > 2 * rows:
        df = df.where(h < F.lit(int(span / n * 2 * rows)))
    return df.distinct().orderBy(h, *df.columns).limit(rows)


_made: dict[tuple, object] = {}


def once_a_worker(name: str, value: Broadcast, make: Callable, *args):
    """``make(value, *args)`` of a broadcast value, made once by each Python worker, which
    keeps the last one only; ``name`` tells the value from all others."""
    key = (name, *args)
    if key not in _made:
        _made.clear()
        _made[key] = make(value.value, *args)
    return _made[key]
