"""A folder that all executors see."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set and the session runs on this
    machine alone, as in tests, a temporary one.  On a cluster that is an error."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="glossweave-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in that folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
