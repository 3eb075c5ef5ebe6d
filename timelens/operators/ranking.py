"""Latest and largest values per time type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_time_type(totals: DataFrame, n: int = 3, by: str = "timeValue") -> DataFrame:
    """The ``n`` first rows of each time type, by descending ``by``.

    With ``timeValue`` these are the latest values, not the largest; pass
    ``totalTime`` for the largest. Time totals are bounded by the calendar, and
    Spark keeps only ``n`` rows per type and task before the exchange.
    """
    order = [F.desc(by)] + ([] if by == "timeValue" else [F.desc("timeValue")])
    ranked = Window.partitionBy("timeType").orderBy(*order)
    return totals.withColumn("rnk", F.row_number().over(ranked)).filter(F.col("rnk") <= n)


def order_output(top: DataFrame) -> DataFrame:
    return top.orderBy("timeType", F.desc("totalTime"), F.desc("timeValue"))


def best_recent_year(totals: DataFrame, n: int = 3) -> DataFrame:
    """Of the ``n`` latest years the one with the largest total, as one row."""
    latest = top_per_time_type(totals.filter(F.col("timeType") == "year"), n)
    return (
        latest.orderBy(F.desc("totalTime"), F.desc("timeValue"))
        .limit(1)
        .select(F.col("timeValue").alias("year"), "totalTime")
    )
