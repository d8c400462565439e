"""Names and mentions resolved against entity maps and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions import text


def last_line_wins(entities: DataFrame, by: str) -> DataFrame:
    """One row for each ``by``, that of the largest line number."""
    order = Window.partitionBy(by).orderBy(F.desc("line_no"))
    return entities.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def reversed_map(entries: DataFrame, key: str, value: str) -> DataFrame:
    """A map turned round, (value, key); a value of several keys is an error."""
    rows = entries.groupBy(value).agg(F.count_distinct(key).alias("_n"), F.max(key).alias(key))
    return rows.select(value, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("several keys for "), F.col(value).cast("string")))).alias(key))


def without(entities: DataFrame, excluded: DataFrame, on: str) -> DataFrame:
    return entities.join(excluded.select(on).distinct(), on, "left_anti")


def redirected(df: DataFrame, name: str, redirects: DataFrame, out: str) -> DataFrame:
    """The target of a single redirect hop, or the name itself."""
    hops = redirects.groupBy(F.col("old_title").alias(name)).agg(F.max("new_title").alias("_new"))
    return df.join(hops, name, "left").withColumn(out, F.coalesce("_new", name)).drop("_new")


def resolved(df: DataFrame, name: str, names: DataFrame, redirects: DataFrame, out: str = "entity_id") -> DataFrame:
    """Entity of a link name: as it is, in title case, each through a redirect, and at
    last in lower case; null if none is known.

    ``names``: (name, entity_id).  The lower-case map takes the largest id of a key.
    """
    by_name = names.groupBy(F.col("name").alias("_n")).agg(F.max("entity_id").alias("_id"))
    by_lower = names.groupBy(F.lower("name").alias("_n")).agg(F.max("entity_id").alias("_id"))
    rows = df.withColumn("_raw", F.col(name)).withColumn("_title", text.title_case(F.col(name)))
    steps = []
    for i, source in enumerate(("_raw", "_title")):
        rows = redirected(rows, source, redirects, f"_hop{i}")
        rows = rows.join(by_name.withColumnsRenamed({"_n": f"_hop{i}", "_id": f"_id{i}"}), f"_hop{i}", "left")
        steps.append(f"_id{i}")
    rows = rows.withColumn("_low", F.lower("_raw")).join(by_lower.withColumnsRenamed({"_n": "_low", "_id": "_id2"}), "_low", "left")
    return rows.withColumn(out, F.coalesce(*steps, "_id2")).drop("_raw", "_title", "_hop0", "_hop1", "_low", "_id0", "_id1", "_id2")


def id_or_name(df: DataFrame, entity_id: str, name: str, names: DataFrame, out: str = "resolved_id") -> DataFrame:
    """The id if it is known, else that of the name, else null."""
    known = names.select(F.col("entity_id").alias("_known")).distinct()
    by_name = names.groupBy(F.col("name").alias("_n")).agg(F.max("entity_id").alias("_by_name"))
    rows = df.join(known, df[entity_id] == F.col("_known"), "left").join(by_name, df[name] == F.col("_n"), "left")
    return rows.withColumn(out, F.coalesce("_known", "_by_name")).drop("_known", "_n", "_by_name")


def candidates(spans: DataFrame, span: str, dictionary: DataFrame, frequency: DataFrame, lower: DataFrame | None = None, n: int = 30) -> DataFrame:
    """Candidates of a span's text.

    The spelling as it is wins if it is strictly more frequent than that in title case,
    else the latter; if neither is known, the lower-case one is looked up in the
    dictionary and then in the lower-case dictionary.  ``dictionary``, ``lower``:
    (mention, entity, p); ``frequency``: (mention, freq).  Spans without candidates are
    left out.
    """
    forms = spans.select(F.col(span).alias("span")).where("span is not null").distinct()
    forms = forms.withColumns({"_title": text.title_case(F.col("span")), "_low": F.lower("span")})
    freq = frequency.groupBy("mention").agg(F.max("freq").alias("freq"))
    for form, as_name in (("span", "_f0"), ("_title", "_f1"), ("_low", "_f2")):
        own = freq.select(F.col("mention").alias(f"{as_name}m"), F.col("freq").alias(as_name))
        forms = forms.join(own, F.col(form) == F.col(f"{as_name}m"), "left").drop(f"{as_name}m")
    f0, f1, f2 = (F.coalesce(c, F.lit(0)) for c in ("_f0", "_f1", "_f2"))
    key = F.when(f0 > f1, F.col("span")).when(f1 > 0, F.col("_title")).when(f2 > 0, F.col("_low"))
    picked = forms.select("span", "_low", key.alias("mention"))
    main = picked.where("mention is not null").join(dictionary, "mention").select("span", F.col("mention").alias("matched"), "entity", "p")
    if lower is not None:
        rest = picked.where("mention is null").select("span", F.col("_low").alias("mention")).join(lower, "mention")
        main = main.unionByName(rest.select("span", F.col("mention").alias("matched"), "entity", "p"))
    order = Window.partitionBy("span").orderBy(F.desc("p"), "entity")
    return main.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)


def normalised_mentions(mentions: DataFrame, mention: str, frequency: DataFrame) -> DataFrame:
    """The dictionary key of a mention: an ALL-CAPS one as capitalised words if that is
    known and at least as frequent, an unknown one by its lower case, the mention whose
    name is greatest among those with it."""
    freq = frequency.groupBy("mention").agg(F.max("freq").alias("freq"))
    by_low = frequency.groupBy(F.lower("mention").alias("_low")).agg(F.max("mention").alias("_same"))
    rows = mentions.select(F.col(mention).alias("mention")).where("mention is not null").distinct().withColumn("_cap", text.cap_phrase(F.col("mention"))).withColumn("_low", F.lower("mention"))
    rows = rows.join(freq.withColumnRenamed("freq", "_f"), "mention", "left")
    rows = rows.join(freq.select(F.col("mention").alias("_cap"), F.col("freq").alias("_fc")), "_cap", "left").join(by_low, "_low", "left")
    key = F.when(F.col("_fc").isNotNull() & (F.coalesce("_fc", F.lit(0)) >= F.coalesce("_f", F.lit(0))), F.col("_cap")).when(F.col("_f").isNotNull(), F.col("mention")).otherwise(F.col("_same"))
    return rows.select("mention", key.alias("key"))
