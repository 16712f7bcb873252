"""Running sums in a global order, and the token budget that latches.

A running sum over a whole table is one window in one task.  Here rows are range-partitioned by their
order, each partition is summed by itself, and the sums before a partition (one number for each) are
added, so the work stays spread however long the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpointed


def running_sum(rows: DataFrame, order: str, value: str, into: str = "before", partitions: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows that come earlier; the order must be unique."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(rows)  # range partitioning reads them twice, and counting tokens is dear
    # the partition's number is part of the checkpointed rows, so it doesn't change where a task is run again
    ranged = checkpointed(rows.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))  # n rows at most
    earlier = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_within", within).join(earlier, F.col("_part") == F.col("_p")).select(*rows.columns, (F.col("_within") + F.col("_offset")).cast("long").alias(into))


def degraded(sized: DataFrame, limit: int | None, start: int = 0, order: str = "path", whole: str = "rendered_tokens", content: str = "content_tokens") -> DataFrame:
    """(order, degraded): true from the first row on whose content would exceed the limit.

    The first such row is found as a minimum; the rows before it are all whole, so their sums are right,
    and whatever sums come after it don't matter.
    """
    if limit is None:
        return sized.select(order, F.lit(False).alias("degraded"))
    first = first_over(sized, limit, start, order, whole, content)
    return sized.select(order).crossJoin(first).select(order, past(F.col(order)).alias("degraded"))


def past(order: Column) -> Column:
    """Whether a row that was joined to first_over() comes at or after it."""
    return F.coalesce(order >= F.col("_first"), F.lit(False))


def first_over(sized: DataFrame, limit: int, start: int = 0, order: str = "path", whole: str = "rendered_tokens", content: str = "content_tokens") -> DataFrame:
    """One row (_first): the first of the order whose content would exceed the limit, null if none would."""
    sums = running_sum(sized.select(order, whole, content), order, whole)
    return F.broadcast(sums.where(F.col("before") + F.lit(start) + F.col(content) > limit).agg(F.min(order).alias("_first")))
