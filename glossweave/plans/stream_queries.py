"""Streaming queries: each runs over all files there are and gives what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.plans import span_queries
from glossweave.plans.annotate import annotate, mention_dictionary
from glossweave.plans.tables import ANNOTATIONS, annotations, read
from glossweave.streaming import stream
from glossweave.streaming.shared import shared_folder

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _source(s, d, name):
    return stream.file_stream(s, f"{d}/{name}.parquet*", read(s, d, name).schema)


@query(span_queries.SQL["annotate_corpus"])
def stream_annotate(s, d):
    """Documents as a stream of requests, annotated batch by batch with a dictionary that
    is read once."""
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    links = annotations(s, d).select("mention", F.col("wikiName").alias("name"))
    mention_dictionary(links, read(s, d, "entity_names")).write.parquet(f"{base}/dictionary")
    pem = s.read.parquet(f"{base}/dictionary")
    stream.annotated(_source(s, d, "documents"), lambda batch: annotate(batch, "doc_id", "text", pem), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return s.read.parquet(f"{base}/out").drop("batch")


@query(f"SELECT wikiName AS entity, count(*) AS n FROM ({ANNOTATIONS.replace('DISTINCT ', '')}) WHERE wikiName IS NOT NULL GROUP BY 1")
def stream_universe(s, d):
    """Entities asked for so far, kept up as a state and written whole."""
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    counts = stream.growing_universe(_source(s, d, "annotations"), "wikiName")
    written = counts.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{base}/out"))
    written.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(s, d):
    """Event-time windows over the stream, as they stand at its end."""
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    windows = stream.tumbling(_source(s, d, "events"), "ts", "1 day", ["event_type"], "value")
    written = windows.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{base}/out"))
    written.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out").withColumn("total", F.round("total", 4))


@query()
def stream_coref(s, d):
    """For each mention of a document's stream the earlier one that holds it."""
    base = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    rows = _source(s, d, "annotations").where("doc is not null and mention <> ''").select("doc", F.coalesce("m_offset", F.lit(0)).alias("at"), text.strip(F.col("mention")).alias("mention"))
    found = stream.seen_persons(rows, "doc", "at", "mention")
    found.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")
