"""Row numbers that never sort a whole table, or a hot group, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.session import checked_broadcast, settle


def surrogate_ids(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Dense integer ids 1..n in key order for the distinct keys of ``df``.

    The keys are range-partitioned; each partition is numbered on its own and
    shifted by the sizes of the partitions before it.  Only the list of
    partition sizes (one row per partition) passes through a single task.  The
    range-partitioned keys are settled, so both reads see the same ranges.
    """
    keys = df.select(key).distinct().where(F.col(key).isNotNull())
    ranged = settle(keys.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return (
        ranged.withColumn("__local", local)
        .join(checked_broadcast(shifts), "__part")
        .select(key, (F.col("__shift") + F.col("__local")).cast("long").alias(name))
    )


def grouped_row_number(
    df: DataFrame, groups: Sequence[str], order: str, name: str, block: int = 65_536
) -> DataFrame:
    """``row_number`` within groups by an integer column, in blocks of its range.

    A group of any size is spread over blocks of ``block`` consecutive values:
    each block is numbered on its own and shifted by the row counts of the
    earlier blocks of its group.  Values of ``order`` are unique in a group.
    """
    blocked = df.withColumn("__block", F.expr(f"`{order}` div {block}"))
    keys = [*groups, "__block"]
    sizes = blocked.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return (
        blocked.join(shifts, keys)
        .withColumn(name, (F.col("__shift") + local).cast("long"))
        .drop("__block", "__shift")
    )


def places(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Number all rows 1..n in an order, by ranges: sorted as a whole, but never in one task.

    Rows that tie in ``order`` are numbered in an arbitrary order.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = ranged.withColumn("__local", local).join(checked_broadcast(shifts), "__part")
    return numbered.withColumn(name, (F.col("__shift") + F.col("__local")).cast("long")).drop("__part", "__local", "__shift")
