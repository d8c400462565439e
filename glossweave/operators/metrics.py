"""Matching of predictions against gold, and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.operators import ordered

EPS = 1e-6
SPAN = ["doc", "begin", "end", "entity"]


def strong_matched(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with a flag: a gold mention has the same span and entity."""
    hits = gold.select(*SPAN, F.lit(True).alias("matched")).distinct()
    return preds.join(hits, SPAN, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def _overlapping(own: DataFrame, other: DataFrame, begin: str, end: str, width: int = 32) -> DataFrame:
    """Spans joined with those of the same document and entity that overlap them.

    Both are dealt to stretches of ``width`` positions, so a hot document and entity is
    many groups; a pair that meets in several stretches comes out of its first only.
    """
    def dealt(df: DataFrame, b: str, e: str) -> DataFrame:
        return df.where(F.col(b) < F.col(e)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(b) / width), F.floor((F.col(e) - 1) / width))))

    both = dealt(own, "begin", "end").join(dealt(other, begin, end), ["doc", "entity", "_bin"])
    first = F.floor(F.greatest("begin", begin) / width)
    return both.where((F.col("begin") < F.col(end)) & (F.col(begin) < F.col("end")) & (F.col("_bin") == first)).drop("_bin")


def weak_matched(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with a flag: a gold mention of the same entity overlaps the span."""
    own = preds.select(*SPAN).distinct()
    other = gold.select("doc", "entity", F.col("begin").alias("gb"), F.col("end").alias("ge")).distinct()
    hits = _overlapping(own, other, "gb", "ge").select(*SPAN, F.lit(True).alias("matched")).distinct()
    return preds.join(hits, SPAN, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def gold_scores(preds: DataFrame, gold: DataFrame, weak: bool = True, missing: float = -10_000.0) -> DataFrame:
    """Every gold mention with the best score among the predictions that match it."""
    own = gold.select(*SPAN).distinct()
    if weak:
        other = preds.select("doc", "entity", F.col("begin").alias("pb"), F.col("end").alias("pe"), "score")
        hits = _overlapping(own, other, "pb", "pe")
    else:
        hits = own.join(preds.select(*SPAN, "score"), SPAN)
    best = hits.groupBy(*SPAN).agg(F.max("score").alias("score"))
    return own.join(best, SPAN, "left").withColumn("score", F.coalesce("score", F.lit(missing)))


def confusion(preds: DataFrame, gold: DataFrame, threshold: float, weak: bool = True) -> DataFrame:
    """(doc, tp, fp, fn) at a threshold, documents with at least one of them."""
    flagged = (weak_matched if weak else strong_matched)(preds, gold).where(F.col("score") >= threshold)
    p = flagged.select("doc", F.col("matched").cast("bigint").alias("tp"), (~F.col("matched")).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("fn"))
    missed = gold_scores(preds, gold, weak).where(F.col("score") < threshold)
    zero = F.lit(0).cast("bigint")
    g = missed.select("doc", zero.alias("tp"), zero.alias("fp"), F.lit(1).cast("bigint").alias("fn"))
    return p.unionByName(g).groupBy("doc").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def _f1(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + EPS)


def micro_macro(by_doc: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro and macro precision, recall and F1; macro F1 from the mean P and mean R."""
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    rows = by_doc.withColumns({"_p": p, "_r": r})
    sums = rows.groupBy(*(by or [])).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.avg("_p").alias("macro_p"), F.avg("_r").alias("macro_r"))
    micro_p, micro_r = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    out = sums.withColumns({"micro_p": micro_p, "micro_r": micro_r})
    return out.withColumns({"micro_f1": _f1(F.col("micro_p"), F.col("micro_r")), "macro_f1": _f1(F.col("macro_p"), F.col("macro_r"))})


def threshold_sweep(preds: DataFrame, gold: DataFrame, weak: bool = True) -> DataFrame:
    """(threshold, tp, fp, fn, f1) at every score that occurs, highest first.

    Equal scores form one step, so the sums run over distinct scores only, by ranges of
    scores.
    """
    flagged = (weak_matched if weak else strong_matched)(preds, gold)
    p = flagged.groupBy("score").agg(F.sum(F.col("matched").cast("bigint")).alias("t"), F.sum((~F.col("matched")).cast("bigint")).alias("f"))
    g = gold_scores(preds, gold, weak).groupBy("score").agg(F.count("*").alias("g"))
    steps = p.join(g, "score", "full").select("score", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("t", "f", "g")))
    all_gold = steps.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("all_g"))
    down = ordered.running(steps, [F.desc("score")], {"tp": "t", "fp": "f", "found": "g"})
    rows = down.join(F.broadcast(all_gold)).select("score", "tp", "fp", (F.col("all_g") - F.col("found")).alias("fn"))
    pr, rc = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    return rows.select(F.col("score").alias("threshold"), "tp", "fp", "fn", _f1(pr, rc).alias("f1"))


def best_threshold(preds: DataFrame, gold: DataFrame, weak: bool = True) -> DataFrame:
    """The threshold of the highest F1, the highest of equal ones."""
    return threshold_sweep(preds, gold, weak).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def per_dataset(preds: DataFrame, gold: DataFrame, dataset: Column, validation: Column, weak: bool = True) -> DataFrame:
    """Micro and macro figures of every data set at one threshold, that of the highest F1
    on the documents that ``validation`` is true for; these are not evaluated.

    ``dataset`` and ``validation`` are expressions of ``doc``.
    """
    best = best_threshold(preds.where(validation), gold.where(validation), weak).select("threshold").first()
    threshold = best["threshold"] if best else 0.0
    by_doc = confusion(preds.where(~validation), gold.where(~validation), threshold, weak)
    return micro_macro(by_doc.withColumn("dataset", dataset), ["dataset"]).withColumn("threshold", F.lit(threshold))


def gold_position_buckets(gold: DataFrame, cands: DataFrame, chosen: DataFrame, edges: list[int]) -> DataFrame:
    """Gold mentions by the place of their entity among the candidates, with the shares
    that are solved and that have the right winner.

    ``chosen``: (doc, begin, end, entity, kept), the winner of every span and whether it
    was annotated.  A mention belongs to the first of the ascending ``edges`` that is not
    below its place; mentions whose entity is no candidate to none.
    """
    at = gold.select(*SPAN).distinct().join(cands, SPAN).groupBy(*SPAN).agg(F.min("pos").alias("pos"))
    won = chosen.groupBy(*SPAN).agg(F.max("kept").alias("kept"))
    rows = at.join(won, SPAN, "left")
    edge = F.lit(None).cast("bigint")
    for e in reversed(edges):
        edge = F.when(F.col("pos") <= e, F.lit(e).cast("bigint")).otherwise(edge)
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(edge.alias("upto")).agg(F.count("*").alias("mentions"), share(F.coalesce("kept", F.lit(False))).alias("solved"), share(F.col("kept").isNotNull()).alias("winner")).where("upto is not null")


def candidate_recall(gold: DataFrame, cands: DataFrame, width: int = 10) -> DataFrame:
    """(doc, begin, end, entity, outcome, too_wide): ``no_span`` if the gold span was not
    generated, ``no_entity`` if its entity is no candidate there, else ``hit``; and
    whether it has more than ``width`` words."""
    own = gold.select(*SPAN).distinct()
    spans = cands.select("doc", "begin", "end", F.lit(1).alias("_s")).distinct()
    ents = cands.select(*SPAN, F.lit(1).alias("_e")).distinct()
    rows = own.join(spans, ["doc", "begin", "end"], "left").join(ents, SPAN, "left")
    return rows.select(*SPAN, F.when(F.col("_s").isNull(), "no_span").when(F.col("_e").isNull(), "no_entity").otherwise("hit").alias("outcome"), (F.col("end") - F.col("begin") > width).alias("too_wide"))


def ranked(df: DataFrame, query: str, item: str, score: str) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(score), item)
    return df.withColumn("rank", F.row_number().over(order))


def average_precision(df: DataFrame, query: str, item: str, score: str, label: str) -> DataFrame:
    """Average precision of every query with a relevant item."""
    rows = ranked(df, query, item, score)
    seen = F.sum(label).over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    at = rows.withColumn("_p", seen / F.col("rank")).where(F.col(label) > 0)
    return at.groupBy(F.col(query).alias("query")).agg(F.avg("_p").alias("ap"))


def ndcg(df: DataFrame, query: str, item: str, score: str, label: str, k: int) -> DataFrame:
    """NDCG at ``k`` with gain label / log2(max(2, rank)); 0 without relevant items."""
    gain = lambda rank: F.col(label) / F.log2(F.greatest(F.lit(2), F.col(rank)))
    rows = ranked(df, query, item, score)
    ideal = Window.partitionBy(query).orderBy(F.desc(label), item)
    rows = rows.withColumn("ideal", F.row_number().over(ideal))
    sums = rows.groupBy(F.col(query).alias("query")).agg(F.sum(F.when(F.col("rank") <= k, gain("rank"))).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain("ideal"))).alias("idcg"))
    return sums.select("query", F.coalesce(F.col("dcg") / F.nullif("idcg", F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def mention_accuracy(df: DataFrame, predicted: str, gold: str, has_candidates: str, baseline: str) -> DataFrame:
    """Precision over mentions with candidates, recall over all, and how often the system
    and the baseline are right or wrong together."""
    right, base = F.coalesce(F.col(predicted) == F.col(gold), F.lit(False)), F.coalesce(F.col(baseline) == F.col(gold), F.lit(False))
    n = lambda c: F.sum(c.cast("bigint"))
    row = df.agg(n(right).alias("right"), n(F.col(has_candidates)).alias("with_cands"), F.count("*").alias("total"), n(right & base).alias("both"), n(right & ~base).alias("system_only"), n(~right & base).alias("baseline_only"), n(~right & ~base).alias("neither"))
    p, r = F.col("right") / F.nullif("with_cands", F.lit(0)), F.col("right") / F.nullif("total", F.lit(0))
    return row.withColumns({"precision": p, "recall": r}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def since_improvement(scores: DataFrame, step: str, score: str, least: float = 0.1) -> DataFrame:
    """Evaluations since the last one that beat the best so far by ``least``.

    The best so far only moves at an improvement, so this is a fold in order of the step.
    """
    rows = scores.agg(F.sort_array(F.collect_list(F.struct(F.col(step).alias("step"), F.col(score).alias("score")))).alias("xs"))
    first = F.struct(F.lit(-1e300).alias("best"), F.lit(0).cast("bigint").alias("since"), F.filter(F.transform("xs", lambda x: F.struct(x["step"].alias("step"), x["score"].alias("score"), F.lit(0.0).alias("best"), F.lit(0).cast("bigint").alias("since"))), lambda x: F.lit(False)).alias("out"))

    def go(acc: Column, x: Column) -> Column:
        better = x["score"] >= acc["best"] + least
        best, since = F.when(better, x["score"]).otherwise(acc["best"]), F.when(better, F.lit(0).cast("bigint")).otherwise(acc["since"] + 1)
        return F.struct(best.alias("best"), since.alias("since"), F.concat(acc["out"], F.array(F.struct(x["step"].alias("step"), x["score"].alias("score"), best.alias("best"), since.alias("since")))).alias("out"))

    return rows.select(F.explode(F.aggregate("xs", first, go, lambda a: a["out"])).alias("r")).select("r.*")
