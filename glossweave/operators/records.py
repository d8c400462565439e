"""Mention records: one mention with its contexts, candidates and gold entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.operators import ordered, reports


def with_gold_position(mentions: DataFrame, cands: str = "cands", gold: str = "gold") -> DataFrame:
    """Adds ``gold_pos``, the 1-based place of the gold id among the candidates, or -1."""
    at = F.array_position(F.transform(cands, lambda c: c["id"]), F.col(gold))
    return mentions.withColumn("gold_pos", F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.lit(-1)).cast("bigint"))


def cut(mentions: DataFrame, n: int, training: bool = False, cands: str = "cands", gold: str = "gold") -> DataFrame:
    """The first ``n`` candidates.  In training a gold one beyond the cut takes the last
    place, in testing its position becomes -1."""
    rows = with_gold_position(mentions, cands, gold)
    kept = F.slice(cands, 1, n)
    if training:
        beyond = F.col("gold_pos") > n
        put_back = F.concat(F.slice(cands, 1, n - 1), F.slice(cands, F.greatest(F.col("gold_pos"), F.lit(1)).cast("int"), F.lit(1)))
        kept = F.when(beyond, put_back).otherwise(kept)
    return with_gold_position(rows.withColumn(cands, kept).drop("gold_pos"), cands, gold)


def restricted(mentions: DataFrame, universe: DataFrame, key: str, cands: str = "cands", gold: str = "gold") -> DataFrame:
    """Candidates outside the universe removed, mentions whose gold is outside dropped,
    gold positions found anew."""
    ids = universe.select(F.col("id").alias("_id")).distinct()
    rows = mentions.select(key, gold, F.posexplode_outer(cands).alias("_pos", "_c"))
    rows = rows.join(ids, F.col("_c.id") == F.col("_id"), "left")
    lists = rows.groupBy(key, gold).agg(F.sort_array(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_pos", "_c")))).alias("_l"))
    own = lists.select(key, gold, F.transform("_l", lambda x: x["_c"]).alias(cands)).join(ids, F.col(gold) == F.col("_id"), "left_semi")
    return with_gold_position(own, cands, gold)


def lines(mentions: DataFrame, training: bool = False) -> DataFrame:
    """Records as lines (doc, mention, left, right, cands, gold, gold_pos): testing keeps
    mentions without their gold as ``-1``; training drops them."""
    rows = mentions.where("gold_pos > 0") if training else mentions
    cand = lambda c: F.concat_ws(",", c["id"].cast("string"), F.format_string("%.3f", c["p"]), c["name"])
    cands = F.when(F.size("cands") > 0, F.array_join(F.transform("cands", cand), "\t")).otherwise(F.lit("EMPTYCAND"))
    ctx = lambda c: F.when(F.size(c) > 0, F.array_join(c, " ")).otherwise(F.lit("EMPTYCTXT"))
    gold = F.when(F.col("gold_pos") > 0, F.concat_ws(",", F.col("gold_pos").cast("string"), cand(F.get("cands", (F.col("gold_pos") - 1).cast("int"))))).otherwise(F.concat_ws(",", F.lit("-1"), F.col("gold").cast("string")))
    return rows.select(F.concat_ws("\t", "doc", "doc", "mention", ctx(F.col("left")), ctx(F.col("right")), F.lit("CANDIDATES"), cands, F.lit("GT:"), gold).alias("value"))


def parsed(text_lines: DataFrame) -> DataFrame:
    """Lines of ``lines`` back as (doc, mention, left, right, cands, gold_pos, gold)."""
    f = F.split("value", "\t")
    gt = F.array_position(f, "GT:").cast("int")
    items = F.filter(F.slice(f, 7, gt - 7), lambda c: c != "EMPTYCAND")
    cand = lambda c: F.struct(F.get(F.split(c, ",", 3), 0).cast("bigint").alias("id"), F.get(F.split(c, ",", 3), 1).cast("double").alias("p"), F.get(F.split(c, ",", 3), 2).alias("name"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: (w != "") & (w != "EMPTYCTXT"))
    g = F.split(F.get(f, gt), ",")
    pos = F.get(g, 0).cast("bigint")
    return text_lines.where(F.size(f) >= 8).select(F.get(f, 0).alias("doc"), F.get(f, 2).alias("mention"), words(F.get(f, 3)).alias("left"), words(F.get(f, 4)).alias("right"), F.transform(items, cand).alias("cands"), pos.alias("gold_pos"), F.get(g, 1).cast("bigint").alias("gold"))


def grouped_by_document(mentions: DataFrame, doc: str, order: str) -> DataFrame:
    """One row a document with its mentions in order."""
    rest = [c for c in mentions.columns if c not in (doc, order)]
    return mentions.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("mentions"))


def training_pairs(positives: DataFrame, intervals: DataFrame, negatives: int, total: float, width: float) -> DataFrame:
    """(entity, word, n, negative): every positive word of an entity with ``negatives``
    words drawn from frequency intervals (word, lo, hi).

    Draws are a hash of the row and the draw's number, so they repeat from run to run and
    when a lost task is run again.
    """
    rows = positives.select("entity", "word", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("n"))
    share = F.pmod(F.xxhash64("entity", "word", "n"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = reports.drawn(rows.withColumn("at", share * F.lit(total)), intervals.withColumnRenamed("word", "negative"), "negative", "at", width)
    return drawn.select("entity", "word", F.col("n").cast("bigint").alias("n"), "negative")


def padded_batches(df: DataFrame, order: list[str], column: str, size: int, fill: int = 0) -> DataFrame:
    """(batch, place, rest of the columns, column, length): rows in batches of ``size`` in
    an order that tells all apart, their lists filled up to the longest of the batch."""
    n = ordered.running(df.withColumn("_one", F.lit(1).cast("bigint")), [F.col(c) for c in order], {"_n": "_one"}).drop("_one")
    rows = n.withColumns({"batch": F.floor((F.col("_n") - 1) / size).cast("bigint"), "place": (F.col("_n") - 1) % size, "length": F.size(column)}).drop("_n")
    longest = F.max("length").over(Window.partitionBy("batch"))
    return rows.withColumn(column, F.concat(column, F.array_repeat(F.lit(fill).cast(df.schema[column].dataType.elementType), (longest - F.col("length")).cast("int"))))


def shuffled_epochs(df: DataFrame, key: str, times: int, seed: int = 0) -> DataFrame:
    """A table ``times`` over, each epoch in an order of its own that repeats by seed."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return rows.orderBy("epoch", F.xxhash64(F.lit(seed), "epoch", key))
