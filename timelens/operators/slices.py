"""Histogram slices as tidy rows: keys, time levels, counts.

Cells are the common input. A cell says: these keys were active in this clock
hour of this date ``n`` times. Hour rows are cells with ``n = 1``; the rollup
base holds the same cells pre-aggregated. Every aggregation below groups on the
keys *and* a time part, so one hot key spreads over many reducers, and Spark
combines on the map side before each exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.fixed_values import SLICES
from timelens.functions.timeparts import level_number, level_text
from timelens.operators.expand import explode_tags, hour_fanout

LEVELS = ("year", "month", "day", "hour")
BASE_KEYS = ("project", "description", "type")


def is_hourly(slice_type: str) -> bool:
    return "hour" in SLICES[slice_type]


def measure_names(slice_type: str) -> tuple[str, ...]:
    """Value columns of a slice: one plain number, or days and hours."""
    if is_hourly(slice_type):
        return ("hourCount",)
    return ("totalTime",) if slice_type == "yearSum" else ("count", "hourCount")


def hour_cells(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fan entries out to cells. Narrow: no exchange.

    ``seconds`` is the full duration on every hour row. ``starts`` and ``started``
    are the number of entries and their durations on the first row only, so that
    they add up to the true totals.
    """
    rows = hour_fanout(entries)
    first = F.col("k") == 0
    return rows.select(
        *keys,
        F.to_date("startdate").alias("date"),
        F.hour("startdate").alias("hour"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("duration").cast("bigint").alias("seconds"),
        F.when(first, 1).otherwise(0).cast("bigint").alias("starts"),
        F.when(first, F.col("duration")).otherwise(0).cast("bigint").alias("started"),
    )


def tag_cells(cells: DataFrame) -> DataFrame:
    """Cells keyed by tag: a cell counts in full under each of its tags."""
    return explode_tags(cells)


def rollup_base(entries: DataFrame, keys: Sequence[str] = BASE_KEYS) -> DataFrame:
    """Cells added up per keys, date and hour: the one pass over the entries.

    Group, project and tag rollups, totals and time totals all follow from it. Entries
    are dealt out by keys and day before the fan-out, so a task holds the cells of its
    own keys and days only, and not some of all. What goes to one task is of a fixed
    size; a day with more entries of the same keys spans several.
    """
    dealt = entries.withColumn("_day", F.to_date("start")).hint("rebalance", *keys, "_day")
    return (
        hour_cells(dealt, keys)
        .groupBy(*keys, "date", "hour")
        .agg(*[F.sum(c).alias(c) for c in ("n", "seconds", "starts", "started")])
    )


def _number(level: str) -> Column:
    return level_number(level, F.col("date"), F.col("hour")).alias(level)


def add_level_text(rows: DataFrame, levels: Sequence[str]) -> DataFrame:
    return rows.withColumns({level: level_text(level, F.col(level)) for level in levels})


def slice_rows(cells: DataFrame, keys: Sequence[str], slice_type: str) -> DataFrame:
    """One slice: keys, its level columns as text, its measures.

    Struct slices need the number of distinct dates. Adding up per date first
    makes that a plain count, and the first exchange is keyed by date.
    """
    levels = SLICES[slice_type]
    numbers = [_number(level) for level in levels]
    if is_hourly(slice_type):
        counted = cells.groupBy(*keys, *numbers).agg(F.sum("n").alias("hourCount"))
    elif slice_type == "yearSum":
        counted = cells.groupBy(*keys, *numbers).agg(F.sum("seconds").alias("totalTime"))
    else:
        per_day = cells.groupBy(*keys, "date").agg(F.sum("n").alias("n"))
        counted = per_day.groupBy(*keys, *numbers).agg(
            F.count(F.lit(1)).alias("count"), F.sum("n").alias("hourCount")
        )
    return add_level_text(counted, levels)


def all_slices(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All 16 slices in one table: histType, keys, levels, count, hourCount, totalTime.

    Two grouping-sets jobs instead of 16: the hour slices start from cells
    already added up to year, month, weekday and hour, the day slices from cells
    added up per date, so the expansion multiplies small rows only. The finest
    hour slice, by far the largest, is that start itself and is not expanded.
    Levels a slice does not have are null; ``count`` is null in hour slices.
    """
    finest_slice = "hourDayMonthYearCount"
    hourly = [s for s in SLICES if is_hourly(s) and s != finest_slice]
    daily = [s for s in SLICES if not is_hourly(s) and s != "yearSum"]
    n = F.sum("n").alias("n")
    seconds = F.sum("seconds").alias("seconds")

    finest = cells.groupBy(*keys, *[_number(level) for level in LEVELS]).agg(n, seconds)
    by_hour = (
        grouping_sets(finest, keys, LEVELS, {s: SLICES[s] for s in hourly}, [n, seconds])
        .unionByName(finest.withColumn("histType", F.lit(finest_slice)))
        .withColumn("days", F.lit(None).cast("bigint"))
    )

    per_day = cells.groupBy(*keys, "date").agg(n, seconds)
    day_levels = LEVELS[:3]
    per_day = per_day.select(
        *keys, *[level_number(v, F.col("date")).alias(v) for v in day_levels], "n", "seconds"
    )
    by_day = grouping_sets(
        per_day,
        keys,
        day_levels,
        {s: SLICES[s] for s in daily},
        [n, seconds, F.count(F.lit(1)).alias("days")],
    )
    # The year set answers two slices.
    both = F.when(
        F.col("histType") == "yearCount", F.array(F.lit("yearCount"), F.lit("yearSum"))
    ).otherwise(F.array("histType"))
    by_day = by_day.withColumn("histType", F.explode(both)).withColumn(
        "hour", F.lit(None).cast("int")
    )

    rows = by_hour.unionByName(by_day)
    return add_level_text(rows, LEVELS).select(
        "histType",
        *keys,
        *LEVELS,
        F.when(F.col("histType") != "yearSum", F.col("days")).alias("count"),
        F.col("n").alias("hourCount"),
        F.col("seconds").alias("totalTime"),
    )


def grouping_sets(
    rows: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    sets: dict[str, Sequence[str]],
    measures: Sequence[Column],
) -> DataFrame:
    """Aggregate once per named set of levels; the name becomes ``histType``."""
    marks = [F.grouping(level).alias(f"no_{level}") for level in levels]
    grouped = rows.groupingSets(
        [[*keys, *chosen] for chosen in sets.values()], *keys, *levels
    ).agg(*measures, *marks)
    name = None
    for slice_type, chosen in sets.items():
        hit = F.lit(True)
        for level in levels:
            hit = hit & (F.col(f"no_{level}") == (0 if level in chosen else 1))
        name = F.when(hit, slice_type) if name is None else name.when(hit, slice_type)
    return grouped.withColumn("histType", name).drop(*[f"no_{level}" for level in levels])
