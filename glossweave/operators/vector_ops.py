"""Operators on tables of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions import vectors


def top_products(queries: DataFrame, items: DataFrame, k: int, query_rows: int = 10_000, similarity: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query, item, product): the ``k`` items of the highest products with each query.

    Tables are (id, vec).  ``similarity`` gives the matrix of a block of items (rows) and
    all queries of a block (columns); without one it is the product.  The queries are a
    stated, limited set: up to ``query_rows`` of them are broadcast in one piece, more in
    several blocks, so items are never moved; every task keeps the best ``k`` of its own
    items for each query, and only those are merged.  An item that is the query itself
    doesn't count; the higher product goes first, then the smaller item.
    """
    kind = items.schema["id"].dataType.simpleString()
    measure = similarity or (lambda a, b: a @ b.T)
    good = lambda df: df.where("id is not null and vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
    asked = good(queries)
    blocks = max(1, -(-asked.count() // query_rows))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not own.num_rows:
            continue
        shared = items.sparkSession.sparkContext.broadcast((own["id"].combine_chunks(), np.stack(own["vec"].to_numpy(zero_copy_only=False))))
        found = good(items).mapInArrow(_best_of(shared, measure, k), f"query {kind}, item {kind}, product double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = items.sparkSession.createDataFrame([], f"query {kind}, item {kind}, product double")
    order = Window.partitionBy("query").orderBy(F.desc("product"), "item")
    return out.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def _best_of(queries, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = queries.value
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            s = measure(np.stack(batch.column(1).to_numpy(zero_copy_only=False)), q).T
            itself = pc.fill_null(pc.index_in(names, ids), -1).to_numpy()
            s[np.flatnonzero(itself >= 0), itself[itself >= 0]] = -np.inf
            take = min(k, s.shape[1])
            # All that tie with the last one stay, as the smaller item wins.
            row, col = np.nonzero((s >= -np.partition(-s, take - 1, axis=1)[:, take - 1 : take]) & (s > -np.inf))
            new = pa.table({"query": names.take(pa.array(row)), "item": ids.take(pa.array(col)), "product": s[row, col]})
            held = _cut(new if held is None else pa.concat_tables([held, new]), k)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return scan


def _cut(table: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of every query."""
    table = table.take(pc.sort_indices(table, sort_keys=[("query", "ascending"), ("product", "descending"), ("item", "ascending")]))
    code = table["query"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    place = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
    return table.take(pa.array(np.flatnonzero(place < k)))


def mean_pooled(members: DataFrame, table: DataFrame, group: str, member: str, dim: int) -> DataFrame:
    """(group, vec): mean vector of a group's members; unknown members are passed over."""
    rows = members.select(F.col(group).alias("group"), F.col(member).alias("id")).join(table.select("id", "vec"), "id")
    sums = rows.groupBy("group").agg(*(F.avg(F.get("vec", i).cast("double")).alias(f"_{i}") for i in range(dim)))
    return sums.select("group", F.array(*(f"_{i}" for i in range(dim))).alias("vec"))


def partition_sums(words: DataFrame, table: DataFrame, dim: int) -> DataFrame:
    """(id, total): for each word vector the sum of its products with all vectors, by way
    of their one sum."""
    whole = table.agg(*(F.sum(F.get("vec", i).cast("double")).alias(f"_{i}") for i in range(dim))).select(F.array(*(f"_{i}" for i in range(dim))).alias("_sum"))
    return words.join(F.broadcast(whole)).select("id", vectors.dot(F.col("vec"), F.col("_sum")).alias("total"))


def extremes(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of the highest and of the lowest values, each with its rank from its
    end: (end, rank, key, value)."""
    out = None
    for end, order in (("top", [F.desc(value), F.col(key)]), ("bottom", [F.asc(value), F.col(key)])):
        best = df.where(F.col(value).isNotNull()).orderBy(*order).limit(k)
        ranked = best.select(F.lit(end).alias("end"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), F.col(key).alias("key"), F.col(value).alias("value"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def annotated_neighbours(near: DataFrame, word_freq: DataFrame) -> DataFrame:
    """Neighbours (entity, word, rank) with how often the word is in the entity's page:
    (entity, word, rank, tf), 0 for words that are not."""
    return near.join(word_freq.groupBy("entity", "word").agg(F.max("tf").alias("tf")), ["entity", "word"], "left").withColumn("tf", F.coalesce("tf", F.lit(0)))


def reranked(cands: DataFrame, by_context: int = 3, total: int = 7) -> DataFrame:
    """Of each mention's candidates (mention, cand, p, ctx) the ``by_context`` most similar
    to its context, then the highest priors up to ``total`` in all; ``rank`` by prior."""
    ctx = Window.partitionBy("mention").orderBy(F.desc("ctx"), "cand")
    rows = cands.withColumn("_c", F.row_number().over(ctx) <= by_context)
    fill = Window.partitionBy("mention").orderBy(F.desc("_c"), F.desc("p"), "cand")
    kept = rows.withColumn("_r", F.row_number().over(fill)).where(F.col("_r") <= total)
    prior = Window.partitionBy("mention").orderBy(F.desc("p"), "cand")
    return kept.withColumn("rank", F.row_number().over(prior).cast("bigint")).withColumnRenamed("_c", "by_context").drop("_r")


def extended(base: DataFrame, extension: DataFrame) -> DataFrame:
    """Vectors of the base, and those of the extension that the base lacks."""
    return base.unionByName(extension.join(base.select("id"), "id", "left_anti"))


def missing_words(neighbours: DataFrame, word_freq: DataFrame, least: int) -> DataFrame:
    """Words at least ``least`` times in an entity's page that are not among its nearest:
    (entity, word, tf) without (entity, word) of ``neighbours``."""
    return word_freq.where(F.col("tf") >= least).join(neighbours.select("entity", "word"), ["entity", "word"], "left_anti")


def extension_rows(extension: DataFrame, base: DataFrame) -> DataFrame:
    """Rows (id, row) of an extension matrix that the base map lacks, in row order."""
    return extension.join(base.select("id"), "id", "left_anti").orderBy("row")
