"""Steps several corpus operators share: running totals, checked joins, packed exchanges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.skew import small_enough
from plumbline.session import materialise

# A side of a join is broadcast up to this many rows and bytes, and shuffled beyond.
SMALL_ROWS = 400_000
SMALL_BYTES = 32 * 1024 * 1024


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` up to and including each row, in the global order of ``order``.

    Rows are range-sorted into partitions, whose sums (one row each) are added up first. The
    partitioned rows are written once, so a task that runs again sees the same bounds.
    """
    n = partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "running-total")
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row per partition: bounded by the number of partitions
    joined = dealt.join(F.broadcast(starts), "_part")
    return joined.withColumn(out, F.col("_start") + F.sum(value).over(upto)).drop("_part", "_start")


def join_checked(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """Join a large table to one that may be small: broadcast only after measuring it, never by its compressed size."""
    return left.join(F.broadcast(right) if small_enough(right, SMALL_ROWS, SMALL_BYTES) else right.hint("merge"), on, how)
