"""Streams of documents and events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_a_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.load(path)


def annotated(stream: DataFrame, annotate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of requests annotated and written, each batch once: a batch that
    is run again overwrites its own directory."""

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def growing_universe(stream: DataFrame, entity: str) -> DataFrame:
    """The entities asked for so far, with how often: for the complete or update mode."""
    return stream.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("n"))


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums in windows of ``size``; in a stream rows up to ``late`` late count.

    (An addition of this engine: the pipeline it follows has no event time.)
    """
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sliding(df: DataFrame, ts: str, size: str, step: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.window(ts, size, step).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n", "total")


def seen_persons(stream: DataFrame, doc: str, order: str, mention: str, timeout_ms: int | None = None) -> DataFrame:
    """(doc, mention, super): for each mention of a document's stream the newest earlier,
    longer one that holds it as words.  The state keeps a document's mentions; in a stream
    without end it is dropped ``timeout_ms`` after the last one (a run over what is there
    needs none, and would wait for it)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        # The names by their words: one that holds a mention has its first word.
        by_word: dict[str, list[str]] = {}
        for s in seen:
            for w in set(s.split(" ")):
                by_word.setdefault(w, []).append(s)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for m in rows[mention]:
            held = next((s for s in reversed(by_word.get(m.split(" ")[0], [])) if len(s) > len(m) and f" {m} " in f" {s} "), None)
            out.append({"doc": str(key[0]), "mention": m, "super": held})
            if held is None:
                seen.append(m)
                for w in set(m.split(" ")):
                    by_word.setdefault(w, []).append(m)
        state.update((seen,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out)

    return stream.groupBy(doc).applyInPandasWithState(step, "doc string, mention string, super string", "seen array<string>", "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")
