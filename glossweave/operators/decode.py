"""From scored candidates to annotations."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_candidates(cands: DataFrame, span: list[str], score: str, position: str) -> DataFrame:
    """The highest candidate of every span; of equal ones the first.  Null and NaN scores
    don't count."""
    good = cands.where(F.col(score).isNotNull() & ~F.isnan(score))
    value = F.struct(*[c for c in cands.columns if c not in span])
    best = good.groupBy(*span).agg(F.max_by(value, F.struct(F.col(score), -F.col(position))).alias("_b"))
    return best.select(*span, "_b.*")


def greedy(preds: DataFrame, doc: str = "doc", score: str = "score", begin: str = "begin", end: str = "end", entity: str = "entity") -> DataFrame:
    """Non-overlapping spans: the highest (score, begin, end, entity) first, each taken
    if none of its words is; entity 0 and null take none.

    A document's spans come to a task in order and are looked at as they stream by; only
    those taken are kept, by their ends, so a document of any length costs n log n.
    """
    own = preds.where(F.col(entity).isNotNull() & (F.col(entity).cast("string") != "0") & F.col(score).isNotNull())
    rows = own.select(F.col(doc).alias("doc"), F.col(score).alias("score"), F.col(begin).alias("begin"), F.col(end).alias("end"), F.col(entity).alias("entity"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begins, ends, first = None, [], [], True
        for batch in batches:
            kept = []
            for i, (d, b, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                if first or d != at:
                    at, begins, ends, first = d, [], [], False
                # Taken spans don't overlap, so of those that begin before ``e`` the last ends last.
                n = bisect_left(begins, e)
                if not n or ends[n - 1] <= b:
                    begins.insert(n, b)
                    ends.insert(n, e)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    down = [F.desc(c) for c in ("score", "begin", "end", "entity")]
    return rows.repartition("doc").sortWithinPartitions("doc", *down).mapInArrow(take, kinds)


def above(preds: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return preds.where(F.col(score) >= threshold)


def first_of_each(preds: DataFrame, per: list[str], order: list[str]) -> DataFrame:
    """The first annotation of each entity (or mention) in its document."""
    w = Window.partitionBy(*per).orderBy(*order)
    return preds.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def nearest_given(preds: DataFrame, given: DataFrame, doc: str = "doc") -> DataFrame:
    """Every predicted span with the given span of its document that has the smallest
    distance of both ends, then the first; documents without given spans give nothing.

    The given spans of a document come to a task before its predictions.  A prediction
    looks at them from its own begin outwards, no farther than the best distance so far.
    """
    fields = [f for f in preds.schema.fields if f.name != doc]
    rest = F.struct(*[f.name for f in fields])
    kind = {f.name: f.dataType.simpleString() for f in preds.schema.fields}
    own = preds.select(F.col(doc).alias("doc"), F.lit(1).alias("side"), F.col("begin").cast("bigint").alias("b"), F.col("end").cast("bigint").alias("e"), rest.alias("rest"))
    other = given.select(F.col(doc).alias("doc"), F.lit(0).alias("side"), F.col("begin").cast("bigint").alias("b"), F.col("end").cast("bigint").alias("e"), F.lit(None).cast(own.schema["rest"].dataType).alias("rest"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spans, first = None, [], True
        for batch in batches:
            rows, best = [], []
            for i, (d, side, b, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if first or d != at:
                    at, spans, first = d, [], False
                if not side:
                    spans.append((b, e))
                elif spans:
                    rows.append(i)
                    best.append(_nearest(spans, b, e))
            at_rows = pa.array(rows, pa.int64())
            made = [pa.array([x[j] for x in best], pa.int64()) for j in range(3)]
            yield pa.record_batch([batch.column(0).take(at_rows), batch.column(4).take(at_rows), *made], names=["doc", "rest", "distance", "given_begin", "given_end"])

    inner = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)
    both = own.unionByName(other).where("doc is not null").repartition("doc").sortWithinPartitions("doc", "side", "b", "e")
    near = both.mapInArrow(look, f"doc {kind[doc]}, rest struct<{inner}>, distance bigint, given_begin bigint, given_end bigint")
    return near.select(*(F.col("doc").alias(doc) if c == doc else F.col(f"rest.{c}").alias(c) for c in preds.columns), "distance", "given_begin", "given_end")


def _nearest(spans: list[tuple[int, int]], begin: int, end: int) -> tuple[int, int, int]:
    """(distance, begin, end) of the nearest of sorted spans."""
    right = bisect_left(spans, (begin,))
    left = right - 1
    best = None
    while True:
        for i in (left, right):
            if 0 <= i < len(spans):
                b, e = spans[i]
                found = (abs(b - begin) + abs(e - end), b, e)
                best = found if best is None else min(best, found)
        left, right = left - 1, right + 1
        more = (left >= 0 and begin - spans[left][0] <= best[0]) or (right < len(spans) and spans[right][0] - begin <= best[0])
        if not more:
            return best


def word_to_char(spans: DataFrame, offsets: DataFrame, doc: str = "doc") -> DataFrame:
    """Word spans as character ranges; ``offsets``: (doc, pos, start, stop) of words."""
    first = offsets.select(doc, F.col("pos").alias("begin"), "start")
    last = offsets.select(doc, (F.col("pos") + 1).alias("end"), "stop")
    return spans.join(first, [doc, "begin"]).join(last, [doc, "end"]).withColumn("length", F.col("stop") - F.col("start"))


def responses(preds: DataFrame, doc: str = "doc") -> DataFrame:
    """One JSON list of [start, length, title] lists a document, in order of the start."""
    item = F.struct(F.col("start"), F.col("length"), F.col("title"))
    lists = preds.groupBy(doc).agg(F.sort_array(F.collect_list(item)).alias("_a"))
    # A list of one title is written as JSON by itself, so that it is escaped.
    one = lambda a: F.concat(F.lit("["), a["start"].cast("string"), F.lit(","), a["length"].cast("string"), F.lit(","), F.substr(F.to_json(F.array(a["title"])), F.lit(2)))
    return lists.select(doc, F.concat(F.lit("["), F.array_join(F.transform("_a", one), ","), F.lit("]")).alias("response"))
