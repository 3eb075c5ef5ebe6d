"""Row generators: clock hours of an entry, tags of an entry, days of a calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.functions.timeparts import week_start
from timelens.functions.zones import keeps_offset
from timelens.session import has_fixed_offset, session_zone


def _later_hours(start: Column, end: Column, zone: str) -> Column:
    """How many clock hours after its first one an entry touches.

    While the zone keeps its offset, hours of the clock pass as hours do. Only for an
    entry near a change of the offset are the hours looked at one by one.
    """
    hours = F.timestamp_diff("HOUR", F.date_trunc("hour", start), F.date_trunc("hour", end))
    passed = F.greatest(F.lit(0).cast("bigint"), hours)
    if has_fixed_offset(zone):
        return passed
    return F.when(is_calm(start, end, zone), passed).otherwise(_hours_on_the_wall(start, end))


def is_calm(start: Column, end: Column, zone: str) -> Column:
    """True when no clock hour that an entry touches, or the one after, sees a change."""
    lower = F.timestamp_add("HOUR", F.lit(-1), F.least(start, end))
    upper = F.timestamp_add("HOUR", F.lit(2), F.greatest(start, end))
    return keeps_offset(lower, upper, zone)


def _hours_on_the_wall(start: Column, end: Column) -> Column:
    """The fan-out by the clock on the wall, step by step.

    It stops at the first step whose wall-clock hour is no longer before that of the end.
    """

    def wall_hour(ts: Column) -> Column:
        return F.date_trunc("hour", ts.cast("timestamp_ntz"))

    elapsed = F.greatest(F.lit(0).cast("bigint"), F.timestamp_diff("HOUR", start, end))
    steps = F.sequence(F.lit(0).cast("bigint"), elapsed + 2)
    arrived = F.transform(
        steps, lambda k: wall_hour(F.timestamp_add("HOUR", k.cast("int"), start)) >= wall_hour(end)
    )
    first = F.array_position(arrived, F.lit(True))
    missed = F.raise_error(F.concat(F.lit("no end found for the entry from "), start.cast("string")))
    return F.when(first > 0, first - 1).otherwise(missed.cast("bigint"))


def hour_fanout(entries: DataFrame) -> DataFrame:
    """One row per clock hour from the hour of ``start`` to the hour of ``end``.

    Row ``k`` has ``startdate = start + k hours``; every entry has row 0, and all
    columns, the full ``duration`` included, are copied to each row.
    """
    zone = session_zone(entries.sparkSession)
    last = _later_hours(F.col("start"), F.col("end"), zone)
    steps = F.sequence(F.lit(0), last.cast("int"))
    return entries.withColumn("k", F.explode(steps)).withColumn(
        "startdate", F.timestamp_add("HOUR", F.col("k"), F.col("start"))
    )


def explode_tags(rows: DataFrame, tag: str = "tag") -> DataFrame:
    """One row per tag; rows without tags disappear.

    The test for emptiness is part of the generator. Left to the optimizer it
    becomes a filter that is pushed down and runs all tag rules a second time.
    """
    return rows.withColumn(tag, F.explode(F.when(F.size("type") > 0, F.col("type"))))


def touching(entries: DataFrame, year: str | None = None, month: str | None = None) -> DataFrame:
    """Entries that can have an hour row in that year (and month).

    Plain comparisons on ``start`` and ``end``, so they reach the scan and skip
    files and row groups before anything is fanned out.
    """
    if year is None:
        return entries
    y, m = int(year), int(month) if month is not None else None
    first = f"{y:04d}-{m or 1:02d}-01 00:00:00"
    if m is None or m == 12:
        following = f"{y + 1:04d}-01-01 00:00:00"
    else:
        following = f"{y:04d}-{m + 1:02d}-01 00:00:00"
    lower, upper = F.lit(first).cast("timestamp"), F.lit(following).cast("timestamp")
    reaches = (F.col("end") >= lower) | (F.col("start") >= lower)
    return entries.filter((F.col("start") < upper) & reaches)


def calendar_days(periods: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """All days of each period, padded to whole Sunday-based weeks."""
    days = F.sequence(
        week_start(F.col(first)), F.date_add(F.col(last), 7 - F.dayofweek(F.col(last)))
    )
    return periods.withColumn("date", F.explode(days))
