import datetime
import random

import pytest
from pyspark.sql import functions as F

from helpers import entries, texts
from timelens.operators.calendar import period
from timelens.functions.zones import transitions
from timelens.operators.expand import calendar_days, explode_tags, hour_fanout, is_calm, touching


def hours(rows):
    return [r["startdate"] for r in hour_fanout(rows).orderBy("entry_id", "k").collect()]


@pytest.mark.parametrize(
    "start, end, wanted",
    [
        ("2021-12-13 14:50:00", "2021-12-13 15:10:00", ["14:50", "15:50"]),
        ("2021-12-13 14:10:00", "2021-12-13 15:00:00", ["14:10", "15:10"]),
        ("2021-12-13 15:10:00", "2021-12-13 14:50:00", ["15:10"]),
        ("2021-12-13 09:00:00", "2021-12-13 09:00:00", ["09:00"]),
        ("2021-12-13 23:59:59", "2021-12-14 00:00:00", ["23:59", "00:59"]),
    ],
)
def test_clock_hours(spark, start, end, wanted):
    found = hours(entries(spark, [("p", "d", ["t"], start, end)]))
    assert [f"{h:%H:%M}" for h in found] == wanted


def brute_force_hours(start, end, zone):
    """Step hour by hour until the wall clock reaches the hour of the end."""

    def wall(instant):
        return instant.astimezone(zone).replace(minute=0, second=0, microsecond=0, tzinfo=None)

    steps = [start]
    while wall(steps[-1]) < wall(end):
        steps.append(steps[-1] + datetime.timedelta(hours=1))
    return steps


def test_fan_out_where_clocks_change(spark):
    from zoneinfo import ZoneInfo

    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    zone, utc = ZoneInfo("America/Los_Angeles"), datetime.timezone.utc
    cases = []
    for day in ("2021-11-07", "2021-03-14", "2021-06-01"):
        midnight = datetime.datetime.fromisoformat(day).replace(tzinfo=zone).astimezone(utc)
        for begin in range(-90, 300, 25):
            for length in (-40, 0, 15, 30, 59, 60, 75, 119, 125, 300, 1500):
                first = midnight + datetime.timedelta(minutes=begin)
                cases.append((first, first + datetime.timedelta(minutes=length)))
    winter = datetime.datetime(2021, 1, 5, 8, 20, tzinfo=utc)
    cases.append((winter, datetime.datetime(2021, 11, 7, 9, 30, tzinfo=utc)))
    made = entries(
        spark, [("p", "d", ["t"], s.isoformat(), e.isoformat()) for s, e in cases]
    )
    found = {}
    for row in hour_fanout(made).selectExpr("entry_id", "k", "unix_seconds(startdate) s").collect():
        found.setdefault(row["entry_id"], {})[row["k"]] = row["s"]
    for i, (s, e) in enumerate(cases):
        wanted = [int(h.timestamp()) for h in brute_force_hours(s, e, zone)]
        assert [found[i][k] for k in sorted(found[i])] == wanted, (s, e)


def test_fall_back_and_spring_forward(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    made = entries(
        spark,
        [
            ("p", "d", ["t"], "2021-11-07T00:30:00-07:00", "2021-11-07T01:45:00-08:00"),
            ("p", "d", ["t"], "2021-03-14T01:30:00-08:00", "2021-03-14T03:30:00-07:00"),
        ],
    )
    rows = hour_fanout(made).selectExpr("entry_id", "date_format(startdate, 'HH:mm') h")
    assert texts(rows, "entry_id", "h") == [
        ("0", "00:30"), ("0", "01:30"), ("1", "01:30"), ("1", "03:30"),
    ]


@pytest.mark.parametrize(
    "name", ["America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kolkata", "Europe/Berlin"]
)
def test_fan_out_in_zones_of_all_kinds(spark, name):
    """Half-hour changes, two changes within a month, none at all, and far-off years."""
    from zoneinfo import ZoneInfo

    spark.conf.set("spark.sql.session.timeZone", name)
    zone, utc = ZoneInfo(name), datetime.timezone.utc
    rng = random.Random(name)
    lengths = (-4000, -61, -30, 0, 20, 59, 61, 180, 1500, 60 * 24 * 40)
    near = [t for t in transitions(name) if 1_500_000_000 < t < 1_800_000_000] or [1_600_000_000]
    cases = []
    for _ in range(150):
        begin = rng.choice(near) + 60 * rng.randrange(-60 * 80, 60 * 50)
        cases.append((begin, begin + 60 * rng.choice(lengths)))
    cases += [(t + 3600 * a, t + 3600 * b) for t in near[:6] for a in (-3, -2, -1, 0, 1) for b in (-2, 0, 1, 2, 3)]
    cases += [(1_600_000_000 + 86_400 * d, 1_600_000_000 + 86_400 * d + 5400) for d in range(0, 730, 11)]
    made = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "entry_id long, s long, e long")
    made = made.selectExpr("entry_id", "timestamp_seconds(s) AS start", "timestamp_seconds(e) AS end", "'x' AS project")
    found = {}
    for row in hour_fanout(made).selectExpr("entry_id", "k", "unix_seconds(startdate) s").collect():
        found.setdefault(row["entry_id"], []).append((row["k"], row["s"]))
    for i, (s, e) in enumerate(cases):
        begin, end = (datetime.datetime.fromtimestamp(t, utc) for t in (s, e))
        wanted = [int(h.timestamp()) for h in brute_force_hours(begin, end, zone)]
        assert [s for _, s in sorted(found[i])] == wanted, (begin, end)
    # Only entries near a change are looked at hour by hour, but all of those.
    calm = made.select("entry_id", is_calm(F.col("start"), F.col("end"), name).alias("calm")).collect()
    for row in calm:
        s, e = sorted(cases[row.entry_id])
        changes = [t for t in transitions(name) if s - 3600 < t <= e + 7200]
        assert not (row.calm and changes)
        if not changes and not [t for t in transitions(name) if s - 40 * 86_400 < t < e + 40 * 86_400]:
            assert row.calm


def test_years_outside_the_table_are_exact_too(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    rows = [("p", "d", ["t"], f"{y}-07-01 10:50:00", f"{y}-07-01 12:10:00") for y in ("1805", "1950", "2199", "2301")]
    found = hour_fanout(entries(spark, rows)).orderBy("entry_id", "k").selectExpr("hour(startdate) AS h")
    assert [r.h for r in found.collect()] == [10, 11, 12] * 4


def test_calm_entries_build_no_array(spark):
    """The hours of the wall clock would fail here; entries of a calm summer never get there."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    made = entries(spark, [("p", "d", ["t"], "2021-06-01 08:10:00", "2021-06-01 10:20:00")] * 3)
    failing = F.raise_error(F.lit("looked at hour by hour")).cast("bigint")
    steps = F.when(is_calm(F.col("start"), F.col("end"), "America/New_York"), F.lit(1)).otherwise(failing)
    assert [r[0] for r in made.select(steps).collect()] == [1, 1, 1]


def test_tags_explode_and_empty_lists_vanish(spark):
    made = entries(
        spark,
        [
            ("p", "d", ["A", "B"], "2021-01-01 00:00:00", "2021-01-01 00:00:00"),
            ("p", "d", [], "2021-01-01 00:00:00", "2021-01-01 00:00:00"),
            ("p", "d", None, "2021-01-01 00:00:00", "2021-01-01 00:00:00"),
        ],
    )
    assert texts(explode_tags(made), "entry_id", "tag") == [("0", "A"), ("0", "B")]


def test_prefilter_keeps_all_hours_of_the_period(spark):
    made = entries(
        spark,
        [
            ("p", "d", ["t"], f"2021-{m:02d}-{d:02d} {h}:30:00", f"2021-{n:02d}-{e:02d} {h}:30:00")
            for m, d, n, e in ((3, 31, 4, 1), (4, 30, 5, 1), (3, 1, 6, 1), (4, 1, 3, 31), (2, 1, 2, 2))
            for h in ("00", "23")
        ],
    )
    rows = hour_fanout(made)
    april = "year(startdate) = 2021 and month(startdate) = 4"
    wanted = texts(rows.filter(april), "entry_id", "k")
    assert texts(hour_fanout(touching(made, "2021", "04")).filter(april), "entry_id", "k") == wanted
    assert touching(made, "2021", "04").count() == 8
    assert touching(made, "2022").count() == 0
    assert touching(made, "2021", "12").count() == 0
    assert touching(made).count() == 10


def test_calendar_weeks_are_whole(spark):
    days = [r["date"] for r in calendar_days(period(spark, "2021-01-01", "2021-12-31")).orderBy("date").collect()]
    assert days[0] == datetime.date(2020, 12, 27) and days[-1] == datetime.date(2022, 1, 1)
    assert len(days) == 371
