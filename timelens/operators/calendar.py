"""Calendar heatmap: every day of a period, zero-filled, with intensity bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelens.functions.timeparts import week_start
from timelens.operators.expand import calendar_days


def day_totals(totals: DataFrame) -> DataFrame:
    """Hours per date out of the time totals."""
    return totals.filter(F.col("timeType") == "date").select(
        F.to_date("timeValue").alias("date"), F.col("totalTime").alias("hours")
    )


def period(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(first).cast("date").alias("first"), F.lit(last).cast("date").alias("last")
    )


def year_periods(years: DataFrame, year: str = "year") -> DataFrame:
    """The period from January 1st to December 31st of each year."""
    y = F.col(year).cast("int")
    return years.select(
        F.make_date(y, F.lit(1), F.lit(1)).alias("first"),
        F.make_date(y, F.lit(12), F.lit(31)).alias("last"),
    )


def calendar_heatmap(days: DataFrame, periods: DataFrame) -> DataFrame:
    """Every day of the padded periods with its hours, 0 where there are none."""
    calendar = calendar_days(periods)
    return calendar.join(days, "date", "left").select(
        "first",
        "last",
        "date",
        week_start(F.col("date")).alias("week_start"),
        (F.dayofweek("date") - 1).alias("dow"),
        F.coalesce("hours", F.lit(0).cast("bigint")).alias("hours"),
    )


def intensity_bins(heatmap: DataFrame) -> DataFrame:
    """Bin 0 for no hours, then quarters of the period's largest day, 1 to 4.

    The window runs over the days of one calendar period, a few hundred rows.
    """
    largest = F.max("hours").over(Window.partitionBy("first", "last"))
    hours, top = F.col("hours"), F.col("largest")
    bins = (
        F.when(hours <= 0, 0)
        .when(hours <= F.ceil(top * 0.25), 1)
        .when(hours <= F.ceil(top * 0.5), 2)
        .when(hours <= F.ceil(top * 0.75), 3)
        .otherwise(4)
    )
    return heatmap.withColumn("largest", largest).withColumn("bin", bins)
