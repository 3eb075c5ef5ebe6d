"""Calendar parts of a clock hour, as numbers for grouping and as text for output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level_number(level: str, date: Column, hour: Column | None = None) -> Column:
    """The integer a level groups on; integers hash faster than formatted text."""
    if level == "year":
        return F.year(date)
    if level == "month":
        return F.month(date)
    if level == "day":
        return F.dayofweek(date) - F.lit(1)
    if level == "hour":
        return hour
    raise ValueError(f"unknown level: {level}")


def padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def level_text(level: str, number: Column) -> Column:
    """Key text of a level: 2021, 04, 0 (Sunday) to 6, 00 to 23."""
    widths = {"year": 4, "month": 2, "day": 1, "hour": 2}
    return padded(number, widths[level])


def week_of_year(date: Column) -> Column:
    """Monday-first week number 0 to 53; days before the first Monday are week 0."""
    return _div(F.dayofyear(date) + 6 - F.weekday(date), 7)


def week_start(date: Column) -> Column:
    """The Sunday on or before a date."""
    return F.date_sub(date, F.dayofweek(date) - 1)


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("int")


def time_values(date: Column, hour: Column) -> dict[str, Column]:
    """timeValue text per time type, for all types that count hour rows."""
    y = level_text("year", F.year(date))
    m = level_text("month", F.month(date))
    d = level_text("day", F.dayofweek(date) - F.lit(1))
    h = level_text("hour", hour)
    ym = F.concat_ws("-", y, m)

    def joined(*parts: Column) -> Column:
        return F.concat_ws("_", *parts)

    return {
        "hour": h,
        "hourYear": joined(y, h),
        "hourMonth": joined(m, h),
        "hourMonthYear": joined(ym, h),
        "hourDay": joined(d, h),
        "hourDayYear": joined(y, d, h),
        "hourDayMonth": joined(m, d, h),
        "hourDayMonthYear": joined(ym, d, h),
        "date": F.date_format(date, "yyyy-MM-dd"),
        "day": d,
        "dayYear": joined(y, d),
        "dayMonth": joined(m, d),
        "dayMonthYear": joined(ym, d),
        "month": m,
        "monthYear": ym,
        "week": joined(padded(week_of_year(date), 2), y),
        "weekMonth": joined(m, _div(F.dayofmonth(date), 7).cast("string")),
    }
