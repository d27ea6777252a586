"""Global numbers and running totals without a single-task window.

Rows are range-partitioned by the order and sorted within their partition; the
partitions' counts and sums, one row each, are added up before them. The
partitioned rows are written to the shared folder, so that their partition numbers
are a fact that survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _spread(df: DataFrame, order: list[str | Column]) -> DataFrame:
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")


def ranked(df: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers from ``start`` in a column ``name``; a
    column of that name is replaced. Rows that tie get different numbers."""
    kept = [c for c in df.columns if c != name]
    parts = _spread(df, order)
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_within", within).join(F.broadcast(starts), "_part").select(*kept, (F.col("_before") + F.col("_within") + (start - 1)).cast("bigint").alias(name))


def running_total(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, 0 for the first; a
    column ``name`` is replaced."""
    kept = [c for c in df.columns if c != name]
    parts = _spread(df, order)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("_within", F.coalesce(within, F.lit(0))).join(F.broadcast(starts), "_part").select(*kept, (F.col("_before") + F.col("_within")).cast("bigint").alias(name))
