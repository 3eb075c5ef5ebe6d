import random

from helpers import entries
from timelens.operators.totals import group_totals
from timelens.plans.jobs import build_rollups
from timelens.plans.pages import chart_series, histogram_page, live_histogram_page, live_slice
from timelens.session import new_work_dir
from timelens.sources.tables import read_table, write_table


def stored(spark):
    rng = random.Random(1)
    rows = [
        (f"p{i % 5}", f"d{i % 3}", ["Work", "Dogs"][: 1 + i % 2],
         f"2021-{1 + i % 12:02d}-{1 + rng.randrange(28):02d} {rng.randrange(24):02d}:15:00",
         f"2021-{1 + i % 12:02d}-28 23:59:00")
        for i in range(60)
    ]
    out = new_work_dir(spark, "entries")
    write_table(entries(spark, rows), out)
    return read_table(spark, out)


def plan_of(rows, run=True):
    if run:
        rows.collect()
    text = rows._jdf.queryExecution().executedPlan().toString()
    return text[: text.rfind("== Initial Plan ==")] if run else text


def test_narrowed_pages_filter_at_the_scan(spark):
    plan = plan_of(live_slice(stored(spark), "group", "dayMonthYearCount", "2021", "04"))
    assert "PushedFilters" in plan and "LessThan(start" in plan
    assert "GreaterThanOrEqual(end" in plan


def test_scans_read_only_used_columns(spark):
    plan = plan_of(group_totals(stored(spark)))
    assert "ReadSchema: struct<project:string,description:string,duration:bigint>" in plan


def test_stored_pages_read_one_partition_and_fan_nothing_out(spark):
    out = new_work_dir(spark, "rollups")
    build_rollups(spark, stored(spark), out)
    rows = histogram_page(spark, out, "group", "dayMonthYearCount", year="2021", month="04")
    plan = plan_of(rows)
    assert "year#" in plan.split("PartitionFilters:")[1][:200] and "EqualTo(month,04)" in plan
    read = rows.inputFiles()
    assert read and all("/histType=dayMonthYearCount/year=2021/" in name for name in read)
    assert "explode" not in plan and "sequence" not in plan
    live = live_histogram_page(stored(spark), "group", "dayMonthYearCount", "2021", "04")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, live.collect()))
    for slice_type in ("yearCount", "yearSum"):
        assert histogram_page(spark, out, "tag", slice_type).count() > 0


def test_pages_scan_once_and_combine_before_the_exchange(spark):
    rows = live_histogram_page(stored(spark), "tag", "hourCount")
    plan = plan_of(rows)
    assert "ReusedExchange" in plan and "partial_sum" in plan
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython"):
        assert slow not in plan


def test_conversion_reaches_every_value(spark):
    rows = live_slice(stored(spark), "project", "hourCount")
    plain = {r["project"]: r["values"] for r in chart_series(rows, "project", "hourCount")[0].collect()}
    doubled = chart_series(rows, "project", "hourCount", convert=lambda v: v * 2)[0]
    assert {r["project"]: r["values"] for r in doubled.collect()} == {
        p: [v * 2 for v in values] for p, values in plain.items()
    }


def test_year_axis_and_tags_come_from_the_data(spark):
    made = entries(
        spark,
        [
            ("p", "d", ["Strange"], "1987-01-01 10:10:00", "1987-01-01 11:00:00"),
            ("p", "d", ["Odd"], "2031-01-01 10:10:00", "2031-01-01 11:00:00"),
        ],
    )
    found = {(r.tag, r.bucket): r.value for r in live_histogram_page(made, "tag", "yearCount").collect()}
    assert found[("Strange", "1987")] == 2 and found[("Odd", "2031")] == 2
    listed = live_histogram_page(made, "tag", "yearCount", tags=["Odd"], years=["2031"]).collect()
    assert [(r.tag, r.tag_order, r.bucket, r.value) for r in listed] == [("Odd", 1, "2031", 2)]
