from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from timelens.functions.labels import (
    axis_label,
    count_label,
    duration_label,
    hours_label,
    ordinal,
    time_label,
)

CASES = [
    ("hour", "00", "12 midnight", "12 midnight"),
    ("hour", "03", "3 am", "3 am"),
    ("hour", "12", "12 noon", "12 noon"),
    ("hour", "15", "3 pm", "3 pm"),
    ("hourDay", "5_15", "Fridays at 3 pm", "Saturdays at 3 pm"),
    ("date", "2020-04-29", "Wednesday, April 29th, 2020", "Wednesday, April 29th, 2020"),
    ("date", "2021-01-01", "Friday, January 1st, 2021", "Friday, January 1st, 2021"),
    ("day", "0", "Sunday", "Monday"),
    ("day", "6", "Saturday", "Sunday"),
    ("week", "00_2022", "1st week of 2022", "1st week of 2022"),
    ("week", "10_2022", "11th week of 2022", "11th week of 2022"),
    ("week", "52_2021", "53rd week of 2021", "1st week of 2021"),
    ("weekMonth", "01_1", "2nd week of Januarys", "2nd week of Februarys"),
    ("weekMonth", "12_4", "5th week of Decembers", "5th week of Januarys"),
    ("month", "01", "January", "February"),
    ("month", "12", "December", "January"),
    ("monthYear", "2021-03", "March in 2021", "April in 2021"),
    ("year", "2021", "2021", "2021"),
    ("hourYear", "2021_05", "2021_05", "2021_05"),
]


@pytest.mark.parametrize("compat", [False, True])
def test_time_labels(spark, compat):
    rows = spark.createDataFrame(CASES, "t string, v string, right string, older string")
    label = time_label(F.col("t"), F.col("v"), compat)
    for row in rows.withColumn("label", label).collect():
        assert row["label"] == row["older" if compat else "right"], row


def calendar_week(day):
    """Sunday-first week number; week 1 holds January 1st."""
    sunday = day - timedelta(days=(day.weekday() + 1) % 7)
    january = date((sunday + timedelta(days=6)).year, 1, 1)
    first = january - timedelta(days=(january.weekday() + 1) % 7)
    return (sunday - first).days // 7 + 1


def test_older_week_labels_of_all_years(spark):
    rows = spark.range(1990, 2030).selectExpr("id y", "explode(sequence(0, 53)) k")
    value = F.concat(F.lpad(F.col("k").cast("string"), 2, "0"), F.lit("_"), F.col("y").cast("string"))
    labelled = rows.withColumn("label", time_label(F.lit("week"), value, compat=True))
    for row in labelled.collect():
        n = calendar_week(date(row["y"], 1, 1) + timedelta(weeks=row["k"]))
        assert row["label"].startswith(str(n)) and row["label"].endswith(f" week of {row['y']}")


def test_ordinals(spark):
    found = spark.range(1, 32).select(ordinal(F.col("id"))).collect()
    named = {1: "1st", 2: "2nd", 3: "3rd", 11: "11th", 12: "12th", 13: "13th", 21: "21st", 22: "22nd", 23: "23rd", 31: "31st"}
    assert [r[0] for r in found] == [named.get(i, f"{i}th") for i in range(1, 32)]


def test_axis_labels(spark):
    one = spark.range(1)
    cases = [
        ("hour", "00", "12am"), ("hour", "09", "9am"), ("hour", "12", "12pm"), ("hour", "23", "11pm"),
        ("day", "0", "Sunday"), ("month", "01", "Jan"), ("month", "09", "Sep"), ("year", "2021", "2021"),
    ]
    for level, key, wanted in cases:
        assert one.select(axis_label(level, F.lit(key))).first()[0] == wanted


def test_durations(spark):
    cases = [
        (0, None), (3599, None), (3600, "1 hour"), (7200, "2 hours"), (86400, "1 day"),
        (90000, "1 day 1 hour"), (40 * 86400 + 7300, "40 days 2 hours"), (-3599, None), (-90000, "-1 days -1 hours"),
    ]
    rows = spark.createDataFrame(cases, "s long, wanted string").withColumn("label", duration_label(F.col("s")))
    for row in rows.collect():
        assert row["label"] == row["wanted"]


def test_counts(spark):
    rows = spark.range(3).select(hours_label(F.col("id")), count_label(F.col("id"))).collect()
    assert [tuple(r) for r in rows] == [("N/A", None), ("1 hour", "1"), ("2 hours", "2")]
