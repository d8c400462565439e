"""Running sums over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.streaming.shared import checkpointed


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds to every row, for each new name, the sum of a column over the rows up to it.

    The rows are range-partitioned by the order; every part is summed by itself, and the
    sums of the parts before it, one row a part, are added.  The order must tell all rows
    apart.  The parts are checkpointed, so that all that follows sees the same ones.
    """
    parts = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy("_part").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_of"), *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum_{n}") for n in sums))
    rows = parts.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    rows = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    return rows.withColumns({n: F.col(n) + F.col(f"_sum_{n}") for n in sums}).drop("_part", "_of", *(f"_sum_{n}" for n in sums))
