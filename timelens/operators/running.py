"""Running totals that do not need a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelens.session import checkpoint_dir


def running_total(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group before this one.

    A window over the group alone would sort a hot group in one task. Instead the
    rows are range-partitioned on (group, order), so a large group spans many
    partitions; each partition runs its own totals, and the totals of the
    partitions before it, one small row per partition and group, are added.
    The partitioned rows are checkpointed, because both steps must see the same
    partition bounds, also when a lost executor has its work done again.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        rows.repartitionByRange(parts, *[F.col(g) for g in group], *order)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    keys = [*group, "_part"]
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*keys)
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return (
        local.join(offsets, keys)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_part", "_local", "_offset")
    )
