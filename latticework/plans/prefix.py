"""Running totals over a global order, and windows along a dimension, without one task for everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def totals_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before, in the given order.

    Range partitions are summed by themselves; a row per partition carries their totals on.
    """
    ready = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ready = written(ready.withColumn("__part", F.spark_partition_id()), "prefix")
    sums = ready.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__first"))  # a row per partition
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ready = ready.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return ready.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__own")).drop("__part", "__own", "__first")


def blocked(df: DataFrame, dim: str, before: int, after: int, least: int = 100_000) -> DataFrame:
    """Rows in blocks along ``dim``, those near a border repeated in the neighbour: __block and __own.

    A window of ``before`` and ``after`` coordinates within (other keys, __block) then sees all it needs
    for the rows that are the block's own, so a long line isn't one task.
    """
    size = max(least, 4 * (before + after + 1))
    d = F.col(f"`{dim}`")
    home = F.floor(d / F.lit(size)).cast("bigint")
    first, last = F.floor((d - F.lit(after)) / F.lit(size)).cast("bigint"), F.floor((d + F.lit(before)) / F.lit(size)).cast("bigint")
    return df.withColumn("__block", F.explode(F.sequence(first, last))).withColumn("__own", F.col("__block") == home)
