import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import entries, texts
from timelens.fixed_values import SLICES, TIME_TYPES
from timelens.operators.nesting import hist_json, nested_maps
from timelens.operators.slices import (
    all_slices,
    hour_cells,
    is_hourly,
    measure_names,
    rollup_base,
    slice_rows,
    tag_cells,
)
from timelens.operators.totals import (
    attach_tags,
    concat_key,
    distinct_tags,
    row_counts,
    split_key,
    time_totals,
    totals,
)

FORMATS = {"year": "%Y", "month": "%m", "day": "%w", "hour": "%H"}


def made_up(n=120, seed=3):
    """Random entries; one project holds a third of them, some end before they start."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        project = "hot" if i % 3 == 0 else f"p{rng.randrange(6)}"
        description = f"d{rng.randrange(3)}"
        tags = sorted(rng.sample(["A", "B", "C", "D"], rng.randrange(1, 4)))
        start = datetime(2019, 12, 20) + timedelta(minutes=rng.randrange(60 * 24 * 500))
        end = start + timedelta(minutes=rng.choice([-30, 0, 5, 50, 130, 1500]))
        rows.append((project, description, tags, str(start), str(end)))
    return rows


ROWS = made_up()


def by_hand(rows):
    """Hour rows as (project, description, tags, hour row, duration, first)."""
    for project, description, tags, start, end in rows:
        s, e = datetime.fromisoformat(start), datetime.fromisoformat(end)
        at, first = s, True
        while True:
            yield project, description, tags, at, int((e - s).total_seconds()), first
            if at.replace(minute=0, second=0) >= e.replace(minute=0, second=0):
                break
            at, first = at + timedelta(hours=1), False


def slice_by_hand(keys, slice_type):
    n, days, seconds = Counter(), defaultdict(set), Counter()
    for project, description, tags, at, duration, _ in by_hand(ROWS):
        entity = {"project": project, "description": description}
        for tag in tags if keys == ["tag"] else [None]:
            entity["tag"] = tag
            key = tuple(entity[k] for k in keys)
            key += tuple(at.strftime(FORMATS[v]) for v in SLICES[slice_type])
            n[key] += 1
            days[key].add(at.date())
            seconds[key] += duration
    measures = {
        "hourCount": n,
        "count": {k: len(v) for k, v in days.items()},
        "totalTime": seconds,
    }
    return sorted(
        (*key, *[str(measures[m][key]) for m in measure_names(slice_type)]) for key in n
    )


KINDS = {"project": ["project"], "group": ["project", "description"], "tag": ["tag"]}


@pytest.fixture(scope="module")
def cells(spark):
    return hour_cells(entries(spark, ROWS), ["project", "description", "type"]).cache()


@pytest.fixture(scope="module")
def base(spark):
    return rollup_base(entries(spark, ROWS)).cache()


@pytest.fixture(scope="module")
def tables(spark, base):
    return {
        kind: all_slices(tag_cells(base) if kind == "tag" else base, keys).cache()
        for kind, keys in KINDS.items()
    }


@pytest.mark.parametrize("kind", KINDS)
def test_all_slices_by_hand(tables, kind):
    keys = KINDS[kind]
    rows = tables[kind].collect()
    for slice_type, levels in SLICES.items():
        mine = [r for r in rows if r["histType"] == slice_type]
        columns = [*keys, *levels, *measure_names(slice_type)]
        assert sorted(tuple(str(r[c]) for c in columns) for r in mine) == slice_by_hand(
            keys, slice_type
        ), slice_type
        for level in set(FORMATS) - set(levels):
            assert all(r[level] is None for r in mine)


@pytest.mark.parametrize("slice_type", ["hourDayMonthYearCount", "dayYearCount", "monthCount", "yearSum"])
def test_one_slice_equals_its_part_of_all(cells, tables, slice_type):
    one = slice_rows(cells, ["project"], slice_type)
    columns = ["project", *SLICES[slice_type], *measure_names(slice_type)]
    part = tables["project"].filter(F.col("histType") == slice_type)
    assert texts(one, *columns) == texts(part, *columns)


def test_hours_add_up_in_every_slice(tables):
    sums = (
        tables["group"].groupBy("project", "description", "histType").agg(F.sum("hourCount").alias("n"))
        .groupBy("project", "description").agg(
            F.countDistinct("n").alias("different"), F.count("n").alias("slices")
        )
    )
    assert {(r["different"], r["slices"]) for r in sums.collect()} == {(1, 16)}


def test_project_is_the_sum_of_its_groups_for_hours(tables):
    def hours(kind):
        rows = tables[kind].filter("histType = 'hourDayCount'")
        return texts(
            rows.groupBy("project", "day", "hour").agg(F.sum("hourCount").alias("n")),
            "project", "day", "hour", "n",
        )

    assert hours("group") == hours("project")


def nest(rows, levels):
    if not levels:
        (row,) = rows
        return row[0] if len(row) == 1 else {"count": row[0], "hourCount": row[1]}
    inside = defaultdict(list)
    for row in rows:
        inside[row[0]].append(row[1:])
    return {k: nest(v, levels[1:]) for k, v in sorted(inside.items())}


@pytest.mark.parametrize("slice_type", SLICES)
def test_nested_maps_and_json(spark, cells, tables, slice_type):
    import json

    levels, names = SLICES[slice_type], measure_names(slice_type)
    rows = slice_rows(cells, ["project"], slice_type)
    wanted = {}
    for row in rows.collect():
        wanted.setdefault(row["project"], []).append(
            tuple(row[v] for v in levels) + tuple(row[m] for m in names)
        )
    wanted = {project: nest(found, levels) for project, found in wanted.items()}
    nested = nested_maps(rows, ["project"], slice_type).withColumn("hist", F.to_json("hist"))
    maps = {r["project"]: json.loads(r["hist"]) for r in nested.collect()}
    assert maps == wanted
    assert all(list(m) == sorted(m) for m in maps.values())
    if is_hourly(slice_type) and slice_type != "hourDayMonthYearCount":
        return
    part = tables["project"].filter(F.col("histType") == slice_type)
    found = {r["project"]: json.loads(r["hist"]) for r in hist_json(part, ["project"]).collect()}
    assert found == wanted


def test_time_totals_by_hand(cells):
    found = {(r["timeType"], r["timeValue"]): r["totalTime"] for r in time_totals(cells).collect()}
    assert {kind for kind, _ in found} == set(TIME_TYPES)
    wanted = Counter()
    years = Counter()
    for *_, at, duration, first in by_hand(ROWS):
        for kind, fmt in {
            "hour": "%H", "hourDayMonthYear": "%Y-%m_%w_%H", "date": "%Y-%m-%d",
            "dayMonth": "%m_%w", "monthYear": "%Y-%m", "week": "%W_%Y",
        }.items():
            wanted[kind, at.strftime(fmt)] += 1
        wanted["weekMonth", f"{at:%m}_{at.day // 7}"] += 1
        if first:
            years[at.strftime("%Y")] += duration
    for key, n in wanted.items():
        assert found[key] == n, key
    assert {v: n for (kind, v), n in found.items() if kind == "year"} == years


def test_weeks_of_every_day(spark):
    days = spark.sql("select explode(sequence(date'2019-01-01', date'2026-12-31')) d")
    cells = days.select(
        F.col("d").alias("date"), F.lit(0).alias("hour"), F.lit(1).cast("long").alias("n"),
        F.lit(0).cast("long").alias("starts"), F.lit(0).cast("long").alias("started"),
    )
    rows = time_totals(cells).filter("timeType = 'week'").collect()
    wanted = Counter(
        (datetime(2019, 1, 1) + timedelta(days=i)).strftime("%W_%Y") for i in range(2922)
    )
    assert {r["timeValue"]: r["totalTime"] for r in rows} == wanted


def test_a_year_without_starts_has_no_total(spark):
    made = entries(spark, [("p", "d", ["t"], "2020-12-31 23:30:00", "2021-01-01 01:00:00")])
    rows = time_totals(hour_cells(made, [])).filter("timeType = 'year'").collect()
    assert [(r["timeValue"], r["totalTime"]) for r in rows] == [("2020", 5400)]


def test_totals(spark, base):
    direct = totals(entries(spark, ROWS))
    assert texts(direct, "sliceType", "sliceKey", "totalTime") == texts(
        totals(base, "started"), "sliceType", "sliceKey", "totalTime"
    )
    wanted = Counter()
    for project, description, tags, s, e in ROWS:
        seconds = int((datetime.fromisoformat(e) - datetime.fromisoformat(s)).total_seconds())
        wanted["project", project] += seconds
        wanted["project.description", f"{project}|{description}"] += seconds
        for tag in tags:
            wanted["type", tag] += seconds
    assert {(r["sliceType"], r["sliceKey"]): r["totalTime"] for r in direct.collect()} == wanted


def test_bars_in_names_do_not_merge_groups(spark):
    at = "2021-01-01 00:00:00"
    made = entries(
        spark, [("a|b", "c", ["t"], at, "2021-01-01 00:00:01"), ("a", "b|c", ["t"], at, "2021-01-01 00:00:02")]
    )
    groups = totals(made).filter("sliceType = 'project.description'")
    assert texts(groups, "sliceKey", "totalTime") == [("a|b|c", "1"), ("a|b|c", "2")]


def test_keys_join_and_split(spark):
    one = spark.sql("select 'p' p, 'd' d, cast(null as string) nothing")
    assert one.select(concat_key(F.col("p"), F.col("nothing"))).first()[0] is None
    project, description = split_key(concat_key(F.col("p"), F.col("d")))
    assert tuple(one.select(project, description).first()) == ("p", "d")
    assert tuple(one.select(*split_key(F.lit("p|d|rest"))).first()) == ("p", "d")
    assert tuple(one.select(*split_key(F.lit("|"))).first()) == ("", "")
    with pytest.raises(Exception, match="malformed"):
        one.select(*split_key(F.lit("no bar"))).collect()


def test_distinct_tags_and_join(spark, tables):
    types = distinct_tags(entries(spark, ROWS), ["project"])
    wanted = defaultdict(set)
    for project, _, tags, *_ in ROWS:
        wanted[project] |= set(tags)
    assert {r["project"]: r["types"] for r in types.collect()} == {
        k: sorted(v) for k, v in wanted.items()
    }
    assert attach_tags(tables["project"], types, ["project"]).count() == tables["project"].count()


def test_row_counts(spark):
    counted = row_counts({"one": spark.range(3), "none": spark.range(0)})
    assert texts(counted, "table", "rows") == [("none", "0"), ("one", "3")]


def test_no_task_holds_cells_of_all_keys(spark):
    """Entries of the same cells in all of 8 partitions: each cell is made in one of them."""
    copies = entries(spark, made_up()).crossJoin(spark.range(8)).repartition(8, "id")
    base = rollup_base(copies)
    cells = base.collect()
    assert sorted(r.n for r in cells) == sorted(8 * r.n for r in rollup_base(entries(spark, made_up())).collect())
    added = aggregated_rows(base)
    assert len(added) == 2 and max(added) < 2 * len(cells)


def aggregated_rows(frame):
    """The rows that each aggregation in the plan of a frame has given."""

    def found(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return found(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return found(node.plan())
        own = [int(node.metrics().apply("numOutputRows").value())] if kind == "HashAggregateExec" else []
        children = node.children()
        return own + [n for i in range(children.size()) for n in found(children.apply(i))]

    frame._jdf.collectToPython()
    return found(frame._jdf.queryExecution().executedPlan())


def test_plan_scans_once_and_shares_the_base(spark):
    rows = all_slices(rollup_base(entries(spark, ROWS)), ["project"])
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.rfind("== Initial Plan ==")]
    assert "ReusedExchange" in final
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
