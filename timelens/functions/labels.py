"""Human-readable labels of time values, axis keys and durations.

``compat=True`` reproduces two slips of the labels people know from older
output: weekday names one day late and month names one month late (and the week
number counted from the calendar week that January 1st plus ``k`` weeks falls
in). The default names what the value says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timelens.fixed_values import MONTH_NAMES, WEEKDAY_NAMES
from timelens.functions.timeparts import week_start


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 21st."""
    suffix = (
        F.when((n % 100).between(11, 13), "th")
        .when(n % 10 == 1, "st")
        .when(n % 10 == 2, "nd")
        .when(n % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def _name(names: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in names]), index)


def weekday_name(day: Column, compat: bool = False) -> Column:
    """Name of weekday 0 (Sunday) to 6."""
    return _name(WEEKDAY_NAMES, (day + 1) % 7 if compat else day)


def month_name(month: Column, compat: bool = False) -> Column:
    """Name of month 1 to 12."""
    return _name(MONTH_NAMES, month % 12 if compat else month - 1)


def hour_name(hour: Column) -> Column:
    """3 pm, 12 noon, 12 midnight."""
    return (
        F.when(hour == 0, "12 midnight")
        .when(hour == 12, "12 noon")
        .when(hour < 12, F.concat(hour.cast("string"), F.lit(" am")))
        .otherwise(F.concat((hour - 12).cast("string"), F.lit(" pm")))
    )


def date_name(date: Column) -> Column:
    """Friday, April 29th, 2020."""
    return F.concat(
        F.date_format(date, "EEEE, MMMM"),
        F.lit(" "),
        ordinal(F.dayofmonth(date)),
        F.date_format(date, "', 'yyyy"),
    )


def week_name(week: Column, year: Column, compat: bool = False) -> Column:
    """1st week of 2022."""
    number = week + 1
    if compat:
        january = F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))
        begins = week_start(F.date_add(january, week * 7))
        first = week_start(F.make_date(F.year(F.date_add(begins, 6)), F.lit(1), F.lit(1)))
        number = F.floor(F.date_diff(begins, first) / 7).cast("int") + 1
    return F.concat(ordinal(number), F.lit(" week of "), year)


def time_label(time_type: Column, value: Column, compat: bool = False) -> Column:
    """Text of a time value; types without a text of their own keep the value."""
    parts = F.split(value, "[_-]")

    def text(i: int) -> Column:
        return F.get(parts, F.lit(i))

    def number(i: int) -> Column:
        return text(i).try_cast("int")

    return (
        F.when(time_type == "hour", hour_name(number(0)))
        .when(
            time_type == "hourDay",
            F.concat(weekday_name(number(0), compat), F.lit("s at "), hour_name(number(1))),
        )
        .when(time_type == "date", date_name(value.try_cast("date")))
        .when(time_type == "day", weekday_name(number(0), compat))
        .when(time_type == "week", week_name(number(0), text(1), compat))
        .when(
            time_type == "weekMonth",
            F.concat(
                ordinal(number(1) + 1),
                F.lit(" week of "),
                month_name(number(0), compat),
                F.lit("s"),
            ),
        )
        .when(time_type == "month", month_name(number(0), compat))
        .when(
            time_type == "monthYear",
            F.concat(month_name(number(1), compat), F.lit(" in "), text(0)),
        )
        .otherwise(value)
    )


def axis_label(level: str, key: Column) -> Column:
    """Axis text of a bucket key: Sunday, 2021, Jan, 3pm."""
    number = key.try_cast("int")
    if level == "day":
        return weekday_name(number)
    if level == "month":
        return F.substring(month_name(number), 1, 3)
    if level == "hour":
        clock = F.when(number % 12 == 0, 12).otherwise(number % 12)
        return F.concat(clock.cast("string"), F.when(number < 12, "am").otherwise("pm"))
    return key


def _counted(n: Column, unit: str) -> Column:
    """``3 days``, ``1 day``, and null for none."""
    plural = F.when(n == 1, unit).otherwise(unit + "s")
    return F.when(n != 0, F.concat_ws(" ", n.cast("string"), plural))


def _whole(value: Column, by: int) -> Column:
    """Integer quotient, rounded toward zero."""
    return ((value - value % by) / by).cast("bigint")


def duration_label(seconds: Column) -> Column:
    """Seconds as days and hours, null if less than an hour.

    Days are total days: no months are taken out, so the text does not depend
    on the date it is made.
    """
    days = _whole(seconds, 86400)
    hours = _whole(seconds % 86400, 3600)
    text = F.concat_ws(" ", _counted(days, "day"), _counted(hours, "hour"))
    return F.when(text != "", text)


def hours_label(hours: Column) -> Column:
    """Heatmap text of a day: ``5 hours``, ``N/A`` for none."""
    return F.coalesce(_counted(hours, "hour"), F.lit("N/A"))


def count_label(value: Column) -> Column:
    """Plain bar text: the number, null for 0."""
    return F.when(value != 0, value.cast("string"))
