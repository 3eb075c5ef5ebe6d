import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import texts
from timelens.fixed_values import HOURS, SLICES, YEARS
from timelens.operators.calendar import calendar_heatmap, intensity_bins, period, year_periods
from timelens.operators.hierarchy import hierarchy_sum, share_extents
from timelens.operators.ranking import best_recent_year, order_output, top_per_time_type
from timelens.operators.running import running_total
from timelens.operators.series import (
    axis_keys,
    bucket_winners,
    check_options,
    fill_series,
    known_tags,
    largest_value,
    select_slice,
    series_rows,
    winner_rows,
    winner_series,
)


def series_of(spark, table):
    """{name: values} as filled series over the first hours."""
    return spark.createDataFrame(list(table.items()), "name string, values array<long>")


def winners_by_hand(table):
    n = len(next(iter(table.values())))
    top = [max(v[i] for v in table.values()) for i in range(n)]
    kept = {
        name: [x if x == top[i] else None for i, x in enumerate(values)]
        for name, values in table.items()
    }
    visible = {
        name: [x or 0 for x in values] for name, values in kept.items() if any(x for x in values)
    }
    return kept, visible


@pytest.mark.parametrize("seed", range(4))
def test_winners_by_hand(spark, seed):
    rng = random.Random(seed)
    axis = HOURS[:6]
    table = {f"s{i}": [rng.choice([0, 0, 1, 2, 3, -2]) for _ in axis] for i in range(9)}
    for values in table.values():
        values[2] = 0
    series = series_of(spark, table)
    kept, visible = winners_by_hand(table)
    assert {r["name"]: r["kept"] for r in bucket_winners(series, axis).collect()} == kept
    assert {r["name"]: r["values"] for r in winner_series(series, axis).collect()} == visible
    rows = winner_rows(series, ["name"], axis)
    wanted = [
        (name, axis[i], str(x)) for name, values in kept.items() for i, x in enumerate(values) if x is not None
    ]
    assert texts(rows, "name", "bucket", "value") == sorted(wanted)


def test_ties_stay_and_zero_winners_go(spark):
    table = {"a": [5, 0, 0], "b": [5, 0, 1], "c": [1, 0, 0]}
    visible = {r["name"]: r["values"] for r in winner_series(series_of(spark, table), HOURS[:3]).collect()}
    assert visible == {"a": [5, 0, 0], "b": [5, 0, 1]}


def test_no_series_give_no_winners(spark):
    none = spark.createDataFrame([], "name string, values array<long>")
    assert winner_series(none, HOURS).count() == 0
    assert largest_value(none).first()["largest"] == 0


def test_filling_and_converting(spark):
    leaves = spark.createDataFrame(
        [("a", "01", 2), ("a", "03", 4), ("b", "99", 7), ("c", "00", 0)],
        "name string, bucket string, value long",
    )
    axis = HOURS[:4]
    filled = {r["name"]: r["values"] for r in fill_series(leaves, ["name"], axis).collect()}
    assert filled == {"a": [0, 2, 0, 4]}
    halved = fill_series(leaves, ["name"], axis, lambda v: v / 2)
    assert halved.first()["values"] == [0.0, 1.0, 0.0, 2.0]
    assert texts(series_rows(fill_series(leaves, ["name"], axis), ["name"], axis), "bucket", "value") == [
        ("00", "0"), ("01", "2"), ("02", "0"), ("03", "4"),
    ]


def test_options_of_slices():
    assert check_options("hourMonthYearCount", "2021", "04") == {"year": "2021", "month": "04"}
    assert check_options("hourCount", "2021", None) == {}
    for slice_type, year, month in (
        ("hourYearCount", None, "04"),
        ("hourMonthCount", "2021", None),
        ("dayMonthYearCount", "2021", None),
        ("hourDayCount", "2021", "04"),
        ("nothing", None, None),
    ):
        with pytest.raises(ValueError):
            check_options(slice_type, year, month)
    with pytest.raises(ValueError):
        check_options("dayCount", None, None, "days")
    assert axis_keys("yearSum", YEARS) == YEARS and axis_keys("monthCount", ("1999",))[0] == "01"


def test_selecting_a_slice(spark):
    rows = spark.createDataFrame(
        [("p", "2021", "04", "0", 1, 5), ("p", "2021", "05", "0", 2, 6), ("p", "2022", "04", "1", 3, 7)],
        "project string, year string, month string, day string, count long, hourCount long",
    )
    slice_type = "dayMonthYearCount"
    assert SLICES[slice_type] == ("year", "month", "day")
    found = select_slice(rows, ["project"], slice_type, "2021", "04")
    assert texts(found, "bucket", "value") == [("0", "5")]
    found = select_slice(rows, ["project"], slice_type, "2022", "04", "count")
    assert texts(found, "bucket", "value") == [("1", "3")]
    assert select_slice(rows, ["project"], slice_type, "1999", "04").count() == 0


def test_known_tags_come_in_list_order(spark):
    made = spark.createDataFrame([("B", [1]), ("A", [1]), ("other", [1])], "tag string, values array<long>")
    found = known_tags(made, ("B", "A")).orderBy("tag_order").collect()
    assert [r["tag"] for r in found] == ["B", "A"]


TIMES = [
    ("year", "2020", 10), ("year", "2021", 50), ("year", "2022", 40), ("year", "2023", 50),
    ("year", "2019", 999), ("month", "01", 5), ("month", "02", 9),
]


def test_latest_and_largest(spark):
    made = spark.createDataFrame(TIMES, "timeType string, timeValue string, totalTime long")
    latest = [(r["timeValue"], r["rnk"]) for r in order_output(top_per_time_type(made)).collect()]
    assert latest == [("02", 1), ("01", 2), ("2023", 1), ("2021", 3), ("2022", 2)]
    largest = top_per_time_type(made, 2, "totalTime").filter("timeType = 'year'")
    assert texts(largest, "timeValue", "rnk") == [("2019", "1"), ("2023", "2")]
    assert best_recent_year(made).first()["year"] == "2023"


def test_heatmap_and_bins(spark):
    days = spark.createDataFrame(
        [(date(2021, 1, 1), 9), (date(2020, 12, 28), 10), (date(2021, 1, 5), 3), (date(2021, 1, 9), 4), (date(2020, 12, 26), 99)],
        "date date, hours long",
    )
    rows = intensity_bins(calendar_heatmap(days, period(spark, "2021-01-01", "2021-01-08")))
    found = {r["date"]: r for r in rows.collect()}
    assert sorted(found) == [date(2020, 12, 27) + timedelta(days=i) for i in range(14)]
    assert {r["largest"] for r in found.values()} == {10}
    bins = {d: r["bin"] for d, r in found.items() if r["hours"]}
    assert bins == {date(2021, 1, 1): 4, date(2020, 12, 28): 4, date(2021, 1, 5): 1, date(2021, 1, 9): 2}
    assert found[date(2021, 1, 3)]["dow"] == 0 and found[date(2021, 1, 9)]["week_start"] == date(2021, 1, 3)
    leap = spark.createDataFrame([("2000",)], "year string")
    assert year_periods(leap).first() == (date(2000, 1, 1), date(2000, 12, 31))


def test_empty_heatmap(spark):
    days = spark.createDataFrame([], "date date, hours long")
    rows = intensity_bins(calendar_heatmap(days, period(spark, "2021-01-01", "2021-01-08"))).collect()
    assert {(r["hours"], r["bin"]) for r in rows} == {(0, 0)} and len(rows) == 14


def test_running_total_of_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", f"n{i:04d}", rng.randrange(0, 4)) for i in range(900)]
    made = spark.createDataFrame(rows, "g string, name string, v long")
    found = running_total(made, ["g"], [F.desc("v"), F.asc("name")], "v", "before")
    wanted, sums = [], {}
    for g, name, v in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        wanted.append((g, name, str(v), str(sums.get(g, 0))))
        sums[g] = sums.get(g, 0) + v
    assert texts(found, "g", "name", "v", "before") == sorted(wanted)


GROUPS = [("a", "x", 30), ("a", "y", 10), ("b", "x", 40), ("b", "z", 20), ("c", "x", 0)]


def test_hierarchy(spark):
    made = spark.createDataFrame(GROUPS, "project string, description string, totalTime long")
    found = {(r["depth"], r["project"], r["description"]): r["total"] for r in hierarchy_sum(made).collect()}
    assert found == {
        (0, None, None): 100, (1, "a", None): 40, (1, "b", None): 60, (1, "c", None): 0,
        **{(2, p, d): v for p, d, v in GROUPS},
    }


def test_extents(spark):
    made = spark.createDataFrame(GROUPS, "project string, description string, totalTime long")
    turn = 2 * math.pi
    found = {
        (r["project"], r["description"]): (r["depth"], r["x0"] / turn, r["x1"] / turn)
        for r in share_extents(made, turn).collect()
    }
    wanted = {
        (None, None): (0, 0.0, 1.0),
        ("b", None): (1, 0.0, 0.6), ("a", None): (1, 0.6, 1.0), ("c", None): (1, 1.0, 1.0),
        ("b", "x"): (2, 0.0, 0.4), ("b", "z"): (2, 0.4, 0.6),
        ("a", "x"): (2, 0.6, 0.9), ("a", "y"): (2, 0.9, 1.0), ("c", "x"): (2, 1.0, 1.0),
    }
    assert set(found) == set(wanted)
    for node, (depth, x0, x1) in wanted.items():
        assert found[node][0] == depth
        assert found[node][1:] == pytest.approx((x0, x1))


def test_extents_without_any_time(spark):
    made = spark.createDataFrame([("a", "x", 0)], "project string, description string, totalTime long")
    assert {(r["x0"], r["x1"]) for r in share_extents(made).collect()} == {(0.0, 0.0)}
