"""Chart series: pick a slice, fill the axis, keep the winner of every bucket."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.fixed_values import CHART_SLICES, DAYS, HOURS, MONTHS, SLICES, TAGS
from timelens.operators.slices import measure_names

DOMAINS = {"hour": HOURS, "day": DAYS, "month": MONTHS}


def axis_keys(slice_type: str, years: Sequence[str] = ()) -> tuple[str, ...]:
    """All bucket keys on the axis of a slice; only a year axis needs the years."""
    inner = SLICES[slice_type][-1]
    return tuple(years) if inner == "year" else DOMAINS[inner]


def years_of(leaves: DataFrame) -> tuple[str, ...]:
    """The years on the axis of a year slice: all that have data, in order.

    Runs a job; the years are as many as the calendar has.
    """
    return tuple(r.bucket for r in leaves.select("bucket").distinct().orderBy("bucket").collect())


def check_options(
    slice_type: str, year: str | None, month: str | None, count_type: str = "hourCount"
) -> dict[str, str]:
    """The outer levels to select, or an error if the slice needs more options."""
    if slice_type not in CHART_SLICES:
        raise ValueError(f"no chart shows the slice {slice_type}")
    if count_type not in ("count", "hourCount"):
        raise ValueError(f"unknown count type: {count_type}")
    given = {"year": year, "month": month}
    chosen = {}
    for level in SLICES[slice_type][:-1]:
        if given[level] is None:
            raise ValueError(f"the slice {slice_type} needs the option {level}")
        chosen[level] = given[level]
    return chosen


def pick_measure(slice_type: str, count_type: str = "hourCount") -> Column:
    """The one number shown: the plain count, or the chosen field of the struct leaf."""
    names = measure_names(slice_type)
    return F.col(names[0] if len(names) == 1 else count_type)


def select_slice(
    rows: DataFrame,
    keys: Sequence[str],
    slice_type: str,
    year: str | None = None,
    month: str | None = None,
    count_type: str = "hourCount",
) -> DataFrame:
    """Leaf rows (keys, bucket, value) of a slice below the given year and month.

    A year or month without data gives no rows.
    """
    chosen = check_options(slice_type, year, month, count_type)
    for level, value in chosen.items():
        rows = rows.filter(F.col(level) == value)
    bucket = F.col(SLICES[slice_type][-1]).alias("bucket")
    return rows.select(*keys, bucket, pick_measure(slice_type, count_type).alias("value"))


def fill_series(
    leaves: DataFrame,
    keys: Sequence[str],
    axis: Sequence[str],
    convert: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per series with ``values``: a number for every axis key, 0 where missing.

    Series with nothing but zeros are left out. One sum per axis key fills the
    axis inside the aggregation, so the buckets never become rows of their own.
    """
    filled = [
        F.coalesce(F.sum(F.when(F.col("bucket") == key, F.col("value"))), F.lit(0).cast("bigint"))
        for key in axis
    ]
    if convert is not None:
        filled = [convert(value) for value in filled]
    series = leaves.groupBy(*keys).agg(F.array(*filled).alias("values"))
    return series.filter(F.exists("values", lambda v: v != 0))


def series_rows(series: DataFrame, keys: Sequence[str], axis: Sequence[str]) -> DataFrame:
    """Series to rows (keys, bucket, value), one per axis key."""
    buckets = F.array(*[F.lit(key) for key in axis])
    pairs = F.arrays_zip(buckets.alias("bucket"), F.col("values").alias("value"))
    return series.select(*keys, F.inline(pairs).alias("bucket", "value"))


def bucket_winners(series: DataFrame, axis: Sequence[str]) -> DataFrame:
    """Keep of every series only the values that are the largest of their bucket.

    ``kept`` holds null where another series is larger; ties all stay. The
    largest values are one row of ``len(axis)`` numbers, combined on the map
    side, and come back as a scalar: no join and no window over few buckets.
    """
    largest = series.agg(
        F.array(*[F.max(F.col("values")[i]) for i in range(len(axis))]).alias("largest")
    ).scalar()
    kept = F.zip_with("values", "largest", lambda v, top: F.when(v == top, v))
    return series.withColumn("largest", largest).select(
        *[c for c in series.columns if c != "values"], "values", kept.alias("kept")
    )


def winner_rows(series: DataFrame, keys: Sequence[str], axis: Sequence[str]) -> DataFrame:
    """Winners as rows (keys, bucket, value): every series equal to the maximum."""
    won = bucket_winners(series, axis).select(*keys, F.col("kept").alias("values"))
    return series_rows(won, keys, axis).filter(F.col("value").isNotNull())


def winner_series(series: DataFrame, axis: Sequence[str]) -> DataFrame:
    """Series that win a bucket with anything but zero, 0 in the buckets they lose."""
    won = bucket_winners(series, axis).filter(
        F.exists("kept", lambda v: F.coalesce(v != 0, F.lit(False)))
    )
    filled = F.transform("kept", lambda v: F.coalesce(v, F.lit(0)))
    return won.withColumn("values", filled).drop("kept")


def known_tags(series: DataFrame, tags: Sequence[str] = TAGS) -> DataFrame:
    """Tag series of the closed tag list, with their place in it."""
    listed = F.array(*[F.lit(tag) for tag in tags])
    return series.filter(F.col("tag").isin(*tags)).withColumn(
        "tag_order", F.array_position(listed, F.col("tag"))
    )


def group_name(project: Column, description: Column) -> Column:
    return F.concat(project, F.lit(" - "), description)


def largest_value(series: DataFrame) -> DataFrame:
    """The largest value any of the visible series reaches, at least 0."""
    return series.agg(
        F.greatest(F.coalesce(F.max(F.array_max("values")), F.lit(0)), F.lit(0)).alias("largest")
    )
