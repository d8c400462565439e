"""Occurrence and record counts of terms and n-grams from sorted suffixes.

The suffixes of all records (each cut to the longest n-gram asked for) are dealt to
buckets, all of a record with the same first term to one, and every bucket puts its own in
order.  In that order the suffixes that share a prefix of n terms are neighbours (a
common-prefix interval), so one pass gives the count of every n-gram: the length of its
interval.  Its record count is that length less one for each suffix that has an earlier
one of the same record in the interval.  As no record's n-gram is in two buckets, the
counts of the buckets add up.

Suffixes travel in columns, compressed, with a dictionary of their terms.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm._arrow import lengths, ranges, text_codes, unchunk

#: Into so many classes the first terms of a record are dealt, so that one that fills a
#: third of the collection still lies in many buckets.
CLASSES = 32


def _dictionary(column) -> pa.DictionaryArray:
    column = unchunk(column)
    return column if isinstance(column, pa.DictionaryArray) else column.dictionary_encode()


def _checks(column: pa.DictionaryArray) -> np.ndarray:
    """A hash of every value, the same on all machines."""
    known = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in column.dictionary.to_pylist()], np.int64)
    return known[column.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.int64)


def dealt(suffixes: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, data): the suffixes (part, t1 .., rec, row, weight) of each bucket."""
    coded = pa.table({c: _dictionary(suffixes[c]) if c not in ("row", "weight") else unchunk(suffixes[c]) for c in suffixes.column_names})
    spread = _checks(coded["t1"].chunk(0)) % CLASSES * 0x9E3779B1 if coded.num_rows else np.zeros(0, np.int64)
    bucket = (_checks(coded["rec"].chunk(0)) + spread if coded.num_rows else spread) % buckets
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    numbers, data = [], []
    for b in np.flatnonzero(np.diff(edges)):
        own = coded.take(pa.array(order[edges[b] : edges[b + 1]]))
        # Only the terms that this bucket has.
        own = pa.table({c: _dictionary(own[c].cast(pa.string())) if pa.types.is_dictionary(own[c].type) else own[c] for c in own.column_names})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(own)
        numbers.append(b)
        data.append(sink.getvalue().to_pybytes())
    yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])


def interval_counts(table: pa.Table, n_max: int) -> pa.Table:
    """Counts of the n-grams of suffixes (part, t1 .., rec, row, weight), in any order.

    Suffixes that are equal in all and have the same ``row`` count once, those of a null
    row each.
    """
    names = [f"t{n}" for n in range(1, n_max + 1)]
    known = {c: text_codes(table[c]) for c in ("part", *names, "rec")}
    codes = [known[c][1] for c in ("part", *names)]
    rec, weight = known["rec"][1], table["weight"].to_numpy()
    row, told = pc.fill_null(table["row"], 0).to_numpy(), pc.is_valid(table["row"]).to_numpy()
    order = np.lexsort((row, rec, *codes[::-1]))
    codes, rec, weight, row, told = [c[order] for c in codes], rec[order], weight[order], row[order], told[order]
    differs = np.ones((len(codes), len(order)), bool)
    for out, c in zip(differs, codes, strict=True):
        out[1:] = c[1:] != c[:-1]
    again = np.zeros(len(order), bool)
    again[1:] = ~differs[:, 1:].any(0) & (rec[1:] == rec[:-1]) & told[1:] & told[:-1] & (row[1:] == row[:-1])
    if again.any():
        codes, rec, weight = [c[~again] for c in codes], rec[~again], weight[~again]
        differs = np.ones((len(codes), len(rec)), bool)
        for out, c in zip(differs, codes, strict=True):
            out[1:] = c[1:] != c[:-1]
    # The suffix before, in order, that belongs to the same record.
    by_rec = np.argsort(rec, kind="stable")
    before = np.full(len(rec), -1, np.int64)
    same = rec[by_rec][1:] == rec[by_rec][:-1]
    before[by_rec[1:][same]] = by_rec[:-1][same]
    begins, out = differs[0], []
    for n in range(1, n_max + 1):
        begins = begins | differs[n]
        interval = np.cumsum(begins) - 1
        repeats = (before >= 0) & (interval[np.maximum(before, 0)] == interval)
        size = int(interval[-1]) + 1 if len(interval) else 0
        occ = np.bincount(interval, weights=weight, minlength=size).astype(np.int64)
        recs = np.bincount(interval[~repeats], minlength=size)
        first = np.flatnonzero(begins)
        counted = codes[n][first] >= 0
        at = first[counted]
        text = lambda c, codes=codes, at=at: known[c][0].take(pa.array(codes[("part", *names).index(c)][at]))
        grams = {c: text(c) if i < n else pa.nulls(len(at), pa.string()) for i, c in enumerate(names)}
        out.append(pa.table({"part": text("part"), **grams, "occ": occ[counted], "recs": recs[counted].astype(np.int64)}))
    return pa.concat_tables(out)


def suffix_counts(df: DataFrame, suffixes: Callable[[pa.RecordBatch], pa.Table], n_max: int, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Counts of all n-grams up to ``n_max`` terms: (part, t1 .. t<n_max>, occ, recs),
    n-grams shorter than ``n_max`` with nulls.

    ``suffixes`` makes a table (part, t1 .., rec, row, weight) of a batch of ``df``:
    ``part`` separates vocabularies, the t columns hold the terms at and after a position
    (null beyond the record's end), ``rec`` names the record, ``row`` a row that may come
    again (or null) and ``weight`` says how often the suffix occurs there.  There are
    enough buckets for each to hold about ``bucket_bytes`` of the input.
    """
    names = [f"t{n}" for n in range(1, n_max + 1)]
    context = df.sparkSession.sparkContext
    pieces = df.rdd.getNumPartitions()
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(2 * context.defaultParallelism, min(math.ceil(stored / bucket_bytes), 8 * pieces))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from dealt(suffixes(batch), buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket and held:
                    yield from counted(held)
                    held = []
                bucket = b
                held.append(data.as_buffer())
        if held:
            yield from counted(held)

    def counted(held: list) -> Iterator[pa.RecordBatch]:
        tables = [pa.ipc.open_stream(h).read_all() for h in held]
        yield from interval_counts(pa.concat_tables(tables).unify_dictionaries(), n_max).combine_chunks().to_batches(max_chunksize=65_536)

    schema = ", ".join(["part string", *(f"{n} string" for n in names), "occ bigint", "recs bigint"])
    sent = df.mapInArrow(deal, "bucket bigint, data binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(count, schema).groupBy("part", *names).agg(F.sum("occ").alias("occ"), F.sum("recs").alias("recs"))


def ngram_counts(df: DataFrame, key: str, terms: str, n_max: int = 3) -> DataFrame:
    """Counts of every n-gram, n = 1..``n_max``, of the lists in ``terms``.

    Null keys and null lists count nothing; an n-gram with a null term is none.  Rows that
    repeat count each, towards one record.  Result: (t1 .. t<n_max>, occ, recs).
    """

    def suffixes(batch: pa.RecordBatch) -> pa.Table:
        lens = lengths(batch.column(1))
        row, at = np.repeat(np.arange(len(lens)), lens), ranges(lens)
        codes = pc.list_flatten(batch.column(1)).dictionary_encode()
        term = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.flatnonzero(term >= 0)
        columns, whole = {}, np.ones(len(begin), bool)
        for n in range(1, n_max + 1):
            ahead = np.minimum(begin + n - 1, max(len(term) - 1, 0))
            whole = whole & (at[begin] + n - 1 < lens[row[begin]])
            whole &= term[ahead] >= 0
            columns[f"t{n}"] = pa.DictionaryArray.from_arrays(pa.array(np.where(whole, term[ahead], 0).astype(np.int32), mask=~whole), codes.dictionary)
        rec = batch.column(0).take(pa.array(row[begin]))
        return pa.table({"part": pa.array([""] * len(begin), pa.string()), **columns, "rec": rec, "row": pa.nulls(len(begin), pa.int64()), "weight": np.ones(len(begin), np.int64)})

    rows = df.where(F.col(key).isNotNull() & F.col(terms).isNotNull()).select(F.col(key).cast("string").alias("rec"), F.col(terms).cast("array<string>").alias("terms"))
    return suffix_counts(rows, suffixes, n_max).drop("part")


#: Keys that begin so are control markers of the token stream.
MARKERS = ("DOCSTART_", "DOCEND", "MMSTART_", "MMEND", "*NL*")


def map_term_counts(df: DataFrame, record: str, maps: dict[str, str], same: list[str]) -> DataFrame:
    """Total and record count of every key of the maps, by the kind named for each map.

    A term is a key without spaces, tabs, carriage returns and line feeds at its ends;
    keys that are empty then, and control markers, are no terms; null, zero or negative
    counts no occurrences.  Rows equal in record, maps and the columns ``same`` count
    once.  Result: (kind, term, occ, recs).
    """
    entries = [F.array_sort(F.map_entries(m)).alias(f"m{i}") for i, m in enumerate(maps)]
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("rec"), *same, *entries)
    made = [F.col(f"m{i}").cast("array<struct<key:string,value:bigint>>").alias(f"m{i}") for i in range(len(maps))]
    told = rows.select("rec", F.xxhash64(*rows.columns).alias("row"), *made)
    kinds = list(maps.values())

    def suffixes(batch: pa.RecordBatch) -> pa.Table:
        # Rows that come again within the batch go first.
        ids = batch.column(1).to_numpy()
        batch = batch.take(pa.array(np.sort(np.unique(ids, return_index=True)[1])))
        out = []
        for i, kind in enumerate(kinds):
            lists = batch.column(2 + i)
            of = np.repeat(np.arange(batch.num_rows), lengths(lists))
            flat = pc.list_flatten(lists)
            keys = flat.field("key").dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()
            count = pc.fill_null(flat.field("value"), 0).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
            trimmed = pc.utf8_trim(keys.dictionary, characters=" \t\r\n").dictionary_encode()
            term_of = trimmed.indices.to_numpy(zero_copy_only=False)
            good = np.array([t != "" and not t.startswith(MARKERS) for t in trimmed.dictionary.to_pylist()], bool)
            term = term_of[keys.indices.to_numpy(zero_copy_only=False)].astype(np.int64) if len(flat) else np.zeros(0, np.int64)
            kept = (count > 0) & good[term] if len(flat) else np.zeros(0, bool)
            # Keys of a row that are the same term come together.
            pair, inverse = np.unique(of[kept] * max(len(good), 1) + term[kept], return_inverse=True)
            weight = np.bincount(inverse, weights=count[kept], minlength=len(pair)).astype(np.int64)
            row = pa.array(pair // max(len(good), 1))
            terms = pa.DictionaryArray.from_arrays(pa.array((pair % max(len(good), 1)).astype(np.int32)), trimmed.dictionary)
            out.append(pa.table({"part": pa.array([kind] * len(pair), pa.string()).dictionary_encode(), "t1": terms, "rec": batch.column(0).take(row).dictionary_encode(), "row": batch.column(1).take(row), "weight": weight}))
        return pa.concat_tables(out).unify_dictionaries().combine_chunks()

    return suffix_counts(told, suffixes, 1).select(F.col("part").alias("kind"), F.col("t1").alias("term"), "occ", "recs")


def marked_terms(df: DataFrame, record: str, maps: dict[str, str], same: list[str], rare_below: int = 10, common_share: float = 0.5) -> DataFrame:
    """Terms with their counts and a mark: ``rare`` for a total below ``rare_below``,
    else ``common`` in more than ``common_share`` of all distinct records, else null."""
    all_records = df.agg(F.count_distinct(record).alias("all_recs"))
    counts = map_term_counts(df, record, maps, same)
    mark = F.when(F.col("occ") < rare_below, "rare").when(F.col("recs") > common_share * F.col("all_recs"), "common")
    return counts.crossJoin(F.broadcast(all_records)).select("kind", "term", "occ", "recs", mark.alias("mark"))
