"""The mention-to-entity dictionary p(entity | mention): counting, merging, cutting.

Long form throughout: (mention, entity, n or p).  Ties always go to the smaller entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions import text


def mention_counts(links: DataFrame, mention: str = "mention", entity: str = "entity") -> DataFrame:
    """How often every mention links to every entity."""
    return links.where(F.col(mention).isNotNull() & F.col(entity).isNotNull()).groupBy(F.col(mention).alias("mention"), F.col(entity).alias("entity")).agg(F.count("*").alias("n"))


def conditional(counts: DataFrame) -> DataFrame:
    """Counts as probabilities of the entity given the mention."""
    total = counts.groupBy("mention").agg(F.sum("n").alias("total"))
    return counts.join(total, "mention").select("mention", "entity", (F.col("n") / F.col("total")).alias("p"))


def ranked(df: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Rank of every entity within its mention, the best ``k`` only if asked for."""
    order = Window.partitionBy("mention").orderBy(F.desc(by), "entity")
    out = df.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return out if k is None else out.where(F.col("rank") <= k)


def merged_counts(sources: list[DataFrame], k: int = 100, valid: DataFrame | None = None) -> DataFrame:
    """Counts of several sources summed, the best ``k`` valid entities of each mention,
    renormalised over what was kept."""
    both = sources[0].select("mention", "entity", "n")
    for s in sources[1:]:
        both = both.unionByName(s.select("mention", "entity", "n"))
    summed = both.groupBy("mention", "entity").agg(F.sum("n").alias("n"))
    if valid is not None:
        summed = summed.join(valid.select("entity").distinct(), "entity", "left_semi")
    kept = ranked(summed, "n", k)
    return kept.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("mention"))).select("mention", "entity", "n", "rank", "p")


def uniform(pairs: DataFrame) -> DataFrame:
    """Every distinct entity of a mention with the same probability."""
    own = pairs.select("mention", "entity").where("mention is not null and entity is not null").distinct()
    return own.select("mention", "entity", (F.lit(1.0) / F.count("*").over(Window.partitionBy("mention"))).alias("p"))


def outer_merged(a: DataFrame, b: DataFrame, cap: float | None = 1.0) -> DataFrame:
    """Two distributions added, an absent entity as 0, capped unless ``cap`` is None."""
    p = F.coalesce("p_a", F.lit(0.0)) + F.coalesce("p_b", F.lit(0.0))
    both = a.select("mention", "entity", F.col("p").alias("p_a")).join(b.select("mention", "entity", F.col("p").alias("p_b")), ["mention", "entity"], "full")
    return both.select("mention", "entity", (F.least(F.lit(cap), p) if cap is not None else p).alias("p"))


def rekeyed(counts: DataFrame, rewrite: Column) -> DataFrame:
    """Counts under rewritten mentions; those that fall together are summed."""
    return counts.select(rewrite.alias("mention"), "entity", "n").groupBy("mention", "entity").agg(F.sum("n").alias("n"))


def retokenised(mentions: DataFrame) -> DataFrame:
    """Mentions of several words rewritten as their tokens joined by single spaces, with a
    flag on those that changed; nothing is merged."""
    spaced = F.array_join(text.tokens(F.col("mention")), " ")
    new = F.when(F.size(F.split("mention", " ")) > 1, spaced).otherwise(F.col("mention"))
    return mentions.select("mention", new.alias("retokenised"), (new != F.col("mention")).alias("changed"))


def one_list_a_mention(lists: DataFrame, frequency: str, line: str) -> DataFrame:
    """Of several candidate lists of a mention the most frequent one, then the first."""
    order = Window.partitionBy("mention").orderBy(F.desc(frequency), line)
    return lists.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def lowercase(dictionary: DataFrame, n: int = 30) -> DataFrame:
    """Candidates under lower-cased mentions that are no mentions themselves: the highest
    p of each entity, the best ``n``."""
    keys = dictionary.select(F.col("mention").alias("lower")).distinct()
    low = dictionary.select(F.lower("mention").alias("lower"), "entity", "p").join(keys, "lower", "left_anti")
    best = low.groupBy(F.col("lower").alias("mention"), "entity").agg(F.max("p").alias("p"))
    return ranked(best, "p", n)


def entity_frequency(counts: DataFrame, least: int = 1) -> DataFrame:
    """Links to every entity over all mentions, of at least ``least``."""
    return counts.groupBy("entity").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)


def most_frequent(freq: DataFrame, by: str = "freq", top: int | None = None, least: int | None = None, skip: int = 0) -> DataFrame:
    """The most frequent entities, without the first ``skip``, up to ``top``, from
    ``least``."""
    out = freq.where(F.col(by) >= least) if least is not None else freq
    out = out.orderBy(F.desc(by), "entity")
    if skip:
        out = out.offset(skip)
    return out.limit(top) if top is not None else out


def compared(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Entries that only one of two dictionaries has, or that differ in p."""
    both = a.select("mention", "entity", F.col("p").alias("p_a")).join(b.select("mention", "entity", F.col("p").alias("p_b")), ["mention", "entity"], "full")
    status = F.when(F.col("p_b").isNull(), "only_a").when(F.col("p_a").isNull(), "only_b").when(F.abs(F.col("p_a") - F.col("p_b")) > tolerance, "differs").otherwise("same")
    return both.withColumn("status", status)


def as_lists(dictionary: DataFrame, k: int = 100) -> DataFrame:
    """One row a mention with its candidates, best first."""
    kept = ranked(dictionary, "p", k)
    lists = kept.groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("rank", "entity", "p"))).alias("c"))
    return lists.select("mention", F.transform("c", lambda c: F.struct(c["entity"].alias("entity"), c["p"].alias("p"))).alias("candidates"))
