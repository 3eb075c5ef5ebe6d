"""Rollup states that add up: sums per clock cell, and active days as bitmaps.

States of two sets of entries merge into the state of both: sums by adding, the days on
which keys were active by OR. A year's days are a bitmap of six numbers per (keys,
year), so the number of distinct dates in a month or on a weekday is a number of bits
under a mask, and no entry or date is looked at again. Every row has its year as text,
so a state is stored by year and a change rewrites only the years it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.fixed_values import SLICES
from timelens.functions.timeparts import level_number, level_text
from timelens.operators.slices import LEVELS, add_level_text, grouping_sets, is_hourly
from timelens.operators.totals import distinct_tags

#: Numbers of 64 days each that hold the days of a year.
WORDS = tuple(f"days{i}" for i in range(6))
FINEST = "hourDayMonthYearCount"
#: Slices with a year level are stored by year; of the others each adds up one of them.
YEARLY = tuple(s for s, levels in SLICES.items() if "year" in levels)
YEARLESS = {
    s: next(y for y in YEARLY if y != "yearSum" and set(SLICES[y]) == {*levels, "year"})
    for s, levels in SLICES.items()
    if "year" not in levels
}


def year_text() -> Column:
    return level_text("year", F.year("date"))


def _day_bits(date: Column) -> list[Column]:
    """The bit of a date in each of the numbers of its year."""
    day = F.dayofyear(date) - F.lit(1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), day % 64)
    none = F.lit(0).cast("bigint")
    return [F.when(F.floor(day / 64) == i, bit).otherwise(none) for i in range(len(WORDS))]


def cell_state(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``n`` and ``seconds`` per keys, year, month, weekday and hour."""
    numbers = [level_number(v, F.col("date"), F.col("hour")).alias(v) for v in LEVELS[1:]]
    return cells.groupBy(*keys, year_text().alias("year"), *numbers).agg(
        F.sum("n").alias("n"), F.sum("seconds").alias("seconds")
    )


def day_state(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The days on which keys were active, per keys and year."""
    bits = zip(WORDS, _day_bits(F.col("date")))
    return cells.groupBy(*keys, year_text().alias("year")).agg(
        *[F.bit_or(bit).alias(word) for word, bit in bits]
    )


def tag_state(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted distinct tags per keys. Cells share few tag lists, and only those are taken apart."""
    return distinct_tags(cells.select(*keys, "type").distinct(), list(keys))


def clock_state(cells: DataFrame) -> DataFrame:
    """``n``, ``starts`` and ``started`` per date and hour: a row per hour of the calendar at most."""
    return cells.groupBy("date", "hour").agg(*[F.sum(c).alias(c) for c in ("n", "starts", "started")])


def merged_sums(states: DataFrame, sums: Sequence[str]) -> DataFrame:
    """States of several sets of entries, one below the other, as one."""
    keys = [c for c in states.columns if c not in sums]
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).select(*states.columns)


def merged_days(states: DataFrame) -> DataFrame:
    keys = [c for c in states.columns if c not in WORDS]
    return states.groupBy(*keys).agg(*[F.bit_or(c).alias(c) for c in WORDS]).select(*states.columns)


def merged_tags(states: DataFrame) -> DataFrame:
    """Sorted distinct tags of rows (keys, types)."""
    keys = [c for c in states.columns if c != "types"]
    lists = F.flatten(F.collect_list("types"))
    return states.groupBy(*keys).agg(F.sort_array(F.array_distinct(lists)).alias("types"))


def day_masks(years: DataFrame) -> DataFrame:
    """For every month and weekday of the years its days: 84 rows a year."""
    of_year = F.col("year").cast("int")
    first, last = F.make_date(of_year, F.lit(1), F.lit(1)), F.make_date(of_year, F.lit(12), F.lit(31))
    dates = years.select("year", F.explode(F.sequence(first, last)).alias("date"))
    numbers = [level_number(v, F.col("date")).alias(v) for v in ("month", "day")]
    bits = zip(WORDS, _day_bits(F.col("date")))
    return dates.groupBy("year", *numbers).agg(*[F.bit_or(bit).alias(f"mask_{word}") for word, bit in bits])


def active_days(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``days``: how many dates of a year's month and weekday keys were active on.

    The masks are sent to all tasks: 84 rows for each year of the calendar.
    """
    masks = F.broadcast(day_masks(days.select("year").distinct()))
    counts = [F.bit_count(F.col(w).bitwiseAND(F.col(f"mask_{w}"))) for w in WORDS]
    total = counts[0]
    for count in counts[1:]:
        total = total + count
    found = days.join(masks, "year").withColumn("days", total.cast("bigint"))
    return found.filter("days > 0").select(*keys, "year", "month", "day", "days")


def yearly_slices(cells: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The slices with a year level, as rows of ``all_slices``, from the two states."""
    none = F.lit(None)
    sums = [F.sum("n").alias("n"), F.sum("seconds").alias("seconds")]
    hourly = {s: SLICES[s] for s in YEARLY if is_hourly(s) and s != FINEST}
    by_hour = (
        grouping_sets(cells, keys, LEVELS, hourly, sums)
        .unionByName(cells.withColumn("histType", F.lit(FINEST)))
        .withColumn("days", none.cast("bigint"))
    )
    zero = F.lit(0).cast("bigint")
    of_days = active_days(days, keys).withColumns({"n": zero, "seconds": zero})
    both = cells.drop("hour").withColumn("days", zero).unionByName(of_days)
    daily = {s: SLICES[s] for s in YEARLY if not is_hourly(s) and s != "yearSum"}
    by_day = grouping_sets(both, keys, LEVELS[:3], daily, [*sums, F.sum("days").alias("days")])
    # The year set answers two slices.
    names = F.when(F.col("histType") == "yearCount", F.array(F.lit("yearCount"), F.lit("yearSum")))
    by_day = by_day.withColumn("histType", F.explode(names.otherwise(F.array("histType"))))
    rows = by_hour.unionByName(by_day.withColumn("hour", none.cast("int")))
    return add_level_text(rows, LEVELS[1:]).select(
        "histType",
        *keys,
        *LEVELS,
        F.when(F.col("histType") != "yearSum", F.col("days")).alias("count"),
        F.col("n").alias("hourCount"),
        F.col("seconds").alias("totalTime"),
    )


def yearless_slices(yearly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The slices without a year level: each adds up the years of a slice with one.

    Dates of different years are different dates, so their numbers add up as well.
    """
    names = {of: s for s, of in YEARLESS.items()}
    named = None
    for of, s in names.items():
        hit = F.col("histType") == of
        named = F.when(hit, s) if named is None else named.when(hit, s)
    rows = yearly.filter(F.col("histType").isin(*names)).withColumn("histType", named)
    levels = LEVELS[1:]
    summed = rows.groupBy("histType", *keys, *levels).agg(
        *[F.sum(c).alias(c) for c in ("count", "hourCount", "totalTime")]
    )
    return summed.withColumn("year", F.lit(None).cast("string")).select(*yearly.columns)
