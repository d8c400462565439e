"""Histograms, bucketed accuracy, set comparisons, sampling intervals, experiment logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions import text, vectors
from glossweave.operators import ordered


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in [edge, next) from each edge on, and the counts and share at or above."""
    rows = df.where(F.col(value) >= edges[0]).groupBy(text.bucket(F.col(value), edges).alias("b")).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.element_at(F.array(*map(F.lit, edges)), F.col("b"))
    return rows.select(edge.alias("edge"), "n", F.sum("n").over(down).alias("at_least"), (F.sum("n").over(down) / F.sum("n").over(Window.partitionBy())).alias("share"))


def bucket_accuracy(df: DataFrame, value: str, edges: list[float], right: str) -> DataFrame:
    """Mentions and right ones by the bucket of a value."""
    b = text.bucket(F.col(value), edges)
    return df.groupBy(b.cast("bigint").alias("bucket")).agg(F.count("*").alias("mentions"), F.sum(F.col(right).cast("bigint")).alias("right")).withColumn("accuracy", F.col("right") / F.col("mentions"))


def sample_intervals(freq: DataFrame, key: str, n: str, power: float = 1.0, floor: float = 0.0) -> DataFrame:
    """Half-open intervals [lo, hi) of sizes max(n, floor)^power, one after the other by
    key, for weighted draws."""
    size = F.pow(F.greatest(F.col(n).cast("double"), F.lit(float(floor))), F.lit(power))
    rows = ordered.running(freq.withColumn("_s", size), [F.col(key)], {"hi": "_s"})
    return rows.select(key, (F.col("hi") - F.col("_s")).alias("lo"), "hi")


def drawn(draws: DataFrame, intervals: DataFrame, key: str, at: str, width: float) -> DataFrame:
    """The interval every draw falls into.  Both sides are binned by ``width``, so the
    range condition is checked within a bin only."""
    bins = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    rows = draws.withColumn("_bin", F.floor(F.col(at) / width))
    return rows.join(bins, "_bin").where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("_bin", "lo", "hi")


def unigram(freq: DataFrame, n: str = "n", power: float = 0.75) -> DataFrame:
    """Probability, log probability and its power for every term."""
    total = freq.agg(F.sum(n).alias("_total"))
    p = F.col(n) / F.col("_total")
    return freq.join(F.broadcast(total)).withColumns({"p": p, "log_p": F.ln(p), "p_power": F.pow(p, F.lit(power))}).drop("_total")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, least and greatest value, one row a column."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("r")).select("r.*")
    return rows.groupBy("name").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def quality_counters(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows, and rows that meet each check, in one pass."""
    return df.agg(F.count("*").alias("rows"), *(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")).alias(n) for n, c in checks.items()))


def overlap(sets: DataFrame, name: str, item: str) -> DataFrame:
    """(a, b, both): distinct items that two sets share, a < b.

    Each item is met once with the few sets that hold it.
    """
    held = sets.select(F.col(name).alias("name"), F.col(item).alias("item")).distinct()
    lists = held.groupBy("item").agg(F.sort_array(F.collect_list("name")).alias("ns"))
    pairs = F.flatten(F.transform("ns", lambda a: F.transform(F.filter("ns", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("both"))


def experiment_rows(lines: DataFrame) -> DataFrame:
    """Scores in training logs (run, line_no, line): (run, eval_cnt, mode, dataset,
    average, p, r, f1), each figure with the nearest evaluation, mode and dataset above."""
    up = Window.partitionBy("run").orderBy("line_no")
    got = lambda re: F.nullif(F.regexp_extract("line", re, 1), F.lit(""))
    carried = lambda c: F.last(c, ignorenulls=True).over(up)
    figures = r"^(micro|macro)\s+P:\s*([0-9.]+)\s+R:\s*([0-9.]+)\s+F1:\s*([0-9.]+)"
    rows = lines.withColumns(
        {
            "eval_cnt": carried(got(r"eval_cnt\s*=\s*(\d+)").cast("bigint")),
            "mode": carried(got(r"Evaluating (\w+) datasets")),
            "dataset": carried(F.when(F.col("line").rlike(r"^[\w-]+$"), F.col("line"))),
            "average": got(figures),
        }
    )
    part = lambda i: F.regexp_extract("line", figures, i).cast("double")
    return rows.where("average is not null").select("run", "eval_cnt", "mode", "dataset", "average", part(2).alias("p"), part(3).alias("r"), part(4).alias("f1"))


def thresholds(lines: DataFrame) -> DataFrame:
    """(run, line_no, threshold, f1) of the best thresholds in training logs."""
    best = r"Best validation threshold\s*=\s*([-0-9.eE]+)\s+with F1\s*=\s*([0-9.]+)"
    part = lambda i: F.regexp_extract("line", best, i).try_cast("double")
    return lines.where(F.col("line").rlike(best)).select("run", "line_no", part(1).alias("threshold"), part(2).alias("f1"))


def ordered_runs(rows: DataFrame, dev: str, order: str) -> DataFrame:
    """Runs by their dev figure, the best first."""
    return rows.orderBy(F.desc(dev), order)


def best_runs(rows: DataFrame, group: str, dev: str, order: str) -> DataFrame:
    """The row of the highest dev figure of every group, the earliest of equal ones."""
    w = Window.partitionBy(group).orderBy(F.desc(dev), order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_checkpoint(files: DataFrame, name: str = "file") -> DataFrame:
    """The greatest number at the end of a file name."""
    number = F.nullif(F.regexp_extract(name, r"-(\d+)(?:\.\w+)?$", 1), F.lit("")).cast("bigint")
    return files.agg(F.max(number).alias("latest"))


def prediction_report(preds: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """Every span of a document with what became of it: ``tp``, ``fp`` or ``fn``.

    ``preds`` carries ``matched`` (see ``metrics``) and ``score``; ``gold`` the best score
    among the predictions that match it.
    """
    shown = preds.where(F.col("score") >= threshold).select("doc", "begin", "end", "entity", "score", F.when(F.col("matched"), "tp").otherwise("fp").alias("outcome"))
    missed = gold.where(F.col("score") < threshold).select("doc", "begin", "end", "entity", "score", F.lit("fn").alias("outcome"))
    return shown.unionByName(missed)


def voter_report(voting: DataFrame) -> DataFrame:
    """(doc, voters, weight, top): who votes in a document, the heaviest first."""
    item = F.struct((-F.col("weight")).alias("w"), "cand")
    lists = voting.where("weight > 0").groupBy("doc").agg(F.count("*").alias("voters"), F.sum("weight").alias("weight"), F.array_sort(F.collect_list(item)).alias("v"))
    return lists.select("doc", "voters", "weight", F.transform("v", lambda x: x["cand"]).alias("cands"))


def voter_products(winners: DataFrame, voting: DataFrame) -> DataFrame:
    """(doc, span, cand, voter_span, voter, product): how every voter of another span
    speaks for the winner of a span; made for the few documents of a report."""
    other = voting.select("doc", F.col("span").alias("voter_span"), F.col("cand").alias("voter"), F.col("vec").alias("voter_vec"))
    both = winners.select("doc", "span", "cand", "vec").join(other, "doc").where("span <> voter_span")
    return both.select("doc", "span", "cand", "voter_span", "voter", vectors.dot(F.col("vec"), F.col("voter_vec")).alias("product"))
