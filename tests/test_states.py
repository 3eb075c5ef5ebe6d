"""Rollups that grow: states merge, touched years only, sorted partitions that skip."""

import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import entries
from test_plans import plan_of
from test_rollups import ROWS
from timelens.fixed_values import SLICES
from timelens.operators.slices import all_slices, rollup_base, slice_rows, tag_cells
from timelens.operators.states import (
    YEARLESS,
    YEARLY,
    active_days,
    cell_state,
    day_masks,
    day_state,
    merged_days,
    merged_sums,
    tag_state,
    yearless_slices,
    yearly_slices,
)
from timelens.operators.totals import distinct_tags, time_totals, totals
from timelens.plans.jobs import ROLLUP_KEYS, add_entries, build_rollups, rollup_table
from timelens.plans.pages import histogram_page, live_heatmap_page, live_sunburst_page, stored_slice
from timelens.session import new_work_dir
from timelens.sources import snapshots
from timelens.sources.snapshots import snapshot
from verification import registry


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The tables of these tests are tiny, and growing rollups run many jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(frame, columns=None):
    rows = frame.select(*(columns or sorted(frame.columns)))
    return sorted(tuple(str(v) for v in row) for row in rows.collect())


def random_entries(seed, years, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = datetime(rng.choice(years), 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 364))
        end = start + timedelta(minutes=rng.choice([0, 20, 90, 2000]))
        tags = sorted(rng.sample(["Work", "Fun", "Dogs"], rng.randrange(1, 3)))
        rows.append((f"p{i % 4}", f"d{rng.randrange(3)}", tags, str(start), str(end)))
    return rows


def test_slice_names():
    assert set(YEARLY) | set(YEARLESS) == set(SLICES) and len(YEARLESS) == 7
    for s, of in YEARLESS.items():
        assert set(SLICES[of]) - {"year"} == set(SLICES[s])


@pytest.mark.parametrize("keys", [["project"], ["project", "description"], ["tag"]])
def test_slices_from_states_equal_those_from_entries(spark, keys):
    base = rollup_base(entries(spark, ROWS))
    cells = tag_cells(base) if keys == ["tag"] else base
    yearly = yearly_slices(cell_state(cells, keys), day_state(cells, keys), keys)
    both = yearly.unionByName(yearless_slices(yearly, keys))
    assert rows_of(both) == rows_of(all_slices(cells, keys))


def test_states_merge(spark):
    """States of parts merge to the state of the whole, in any number of parts."""
    rows = random_entries(5, [2019, 2020])
    whole = rollup_base(entries(spark, rows))
    parts = [rollup_base(entries(spark, rows[k::3])) for k in range(3)]
    for state, merge in ((cell_state, lambda s: merged_sums(s, ["n", "seconds"])), (day_state, merged_days)):
        made = [state(p, ["project"]) for p in parts]
        united = made[0].unionByName(made[1]).unionByName(made[2])
        assert rows_of(merge(united)) == rows_of(state(whole, ["project"]))
        assert rows_of(merge(merge(united).unionByName(made[0].limit(0)))) == rows_of(state(whole, ["project"]))


def test_tag_lists_are_taken_apart_once(spark):
    """Cells of many hours share a tag list; the generator gets it once for each project."""
    base = spark.range(0, 4000, 1, 4).selectExpr(
        "concat('p', id % 2) AS project", "IF(id % 4 < 2, array('Work', 'Fun'), array('Dogs')) AS type", "id AS hour"
    )
    found = tag_state(base, ["project"])
    assert rows_of(found) == rows_of(distinct_tags(base, ["project"])) and found.count() == 2

    def generated(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return generated(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return generated(node.plan())
        own = int(node.metrics().apply("numOutputRows").value()) if kind == "GenerateExec" else 0
        children = node.children()
        return own + sum(generated(children.apply(i)) for i in range(children.size()))

    found._jdf.collectToPython()
    assert generated(found._jdf.queryExecution().executedPlan()) == 6


def test_day_maps_hold_every_day_of_long_and_short_years(spark):
    for year, days in (("2020", 366), ("2021", 365), ("1900", 365), ("2000", 366)):
        masks = day_masks(spark.createDataFrame([(year,)], "year string"))
        assert masks.count() == 84
        first = f"make_date({year}, 1, 1)"
        cells = spark.range(days).selectExpr("'k' AS project", f"date_add({first}, CAST(id AS INT)) AS date", "0 AS hour")
        found = active_days(day_state(cells, ["project"]), ["project"])
        assert found.agg(F.sum("days")).first()[0] == days
        by_hand = cells.groupBy(F.month("date").alias("month"), (F.dayofweek("date") - 1).alias("day")).count()
        assert rows_of(found, ["month", "day", "days"]) == rows_of(by_hand, ["month", "day", "count"])
        one = cells.filter("id = 364").unionByName(cells.filter("id = 364"))
        assert [r.days for r in active_days(day_state(one, ["project"]), ["project"]).collect()] == [1]


def names_of(tables, name):
    return dict(tables.tables[name].parts)


def test_a_second_export_gives_what_a_rebuild_gives(spark):
    first, second = random_entries(1, [2018, 2019, 2020]), random_entries(2, [2020, 2021])
    second.append(("new project", "new", ["Beyond"], "2021-12-31 23:10:00", "2022-01-01 00:20:00"))
    grown, rebuilt = new_work_dir(spark, "rollups"), new_work_dir(spark, "rollups")
    build_rollups(spark, entries(spark, first), grown)
    before = snapshot(spark, grown)
    opened = rollup_table(spark, grown, "slices_totalsTyped")
    rows = opened.count()
    add_entries(spark, entries(spark, second), grown, batch="2021.csv")
    build_rollups(spark, entries(spark, first + second), rebuilt)
    after = snapshot(spark, grown)
    assert set(after.tables) == set(snapshot(spark, rebuilt).tables)
    for name in after.tables:
        assert rows_of(rollup_table(spark, grown, name)) == rows_of(rollup_table(spark, rebuilt, name)), name
    assert opened.count() == rows  # a page opened before still answers
    # What lies in untouched years is named as before; touched years are written anew.
    for name in [f"{t}_{k}" for k in ROLLUP_KEYS for t in ("cells", "days", "slices")]:
        old, new = names_of(before, name), names_of(after, name)
        for part, write in new.items():
            touched = any(part.endswith(f"year={y}") for y in (2020, 2021, 2022)) or "HIVE" in part
            assert (old.get(part) != write) == touched, (name, part)
    with pytest.raises(ValueError, match="2021.csv"):
        add_entries(spark, entries(spark, second), grown, batch="2021.csv")
    assert snapshot(spark, grown) == after


def test_nothing_to_add(spark):
    out = new_work_dir(spark, "rollups")
    nothing = entries(spark, [("p", "d", ["Fun"], "2020-01-01 10:00:00", "2020-01-01 10:30:00")]).limit(0)
    build_rollups(spark, nothing, out)
    assert all(rollup_table(spark, out, name).count() == 0 for name in snapshot(spark, out).tables)
    add_entries(spark, entries(spark, random_entries(4, [2020], 20)), out)
    before = rows_of(rollup_table(spark, out, "slices_totalsProject"))
    add_entries(spark, nothing, out)
    assert before and rows_of(rollup_table(spark, out, "slices_totalsProject")) == before


@pytest.mark.parametrize("name", ["totals", "totalsTime"])
def test_totals_without_slices(spark, name):
    """Built and grown alone they are what the base gives."""
    first, second = random_entries(6, [2019, 2020]), random_entries(7, [2020, 2021])
    alone = new_work_dir(spark, "rollups")
    build_rollups(spark, entries(spark, first), alone, [name])
    add_entries(spark, entries(spark, second), alone)
    base = rollup_base(entries(spark, first + second))
    wanted = totals(base, "started") if name == "totals" else time_totals(base)
    assert set(snapshot(spark, alone).tables) == {name, *(["clock"] if name == "totalsTime" else [])}
    assert rows_of(rollup_table(spark, alone, name)) == rows_of(wanted)


def test_pages_of_totals_build_no_slices(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(registry, "order_entries", lambda spark, _: entries(spark, random_entries(9, [1999], 40)))
    for query, page in (("heatmap_all_years", live_heatmap_page), ("share_extents", live_sunburst_page)):
        folder = str(tmp_path / query)
        found = registry.queries()[query](spark, folder)
        assert found.count() == page(registry.order_entries(spark, folder)).count()
        built = [key for key in registry._ROLLUPS if key[1].startswith(folder)]
        tables = snapshot(spark, registry._ROLLUPS[built[0]]).tables
        assert len(built) == 1 and not [t for t in tables if t.startswith(("slices", "cells"))]


def test_only_known_rollups_are_built(spark):
    for names in (["totals", "totalsWeek"], []):
        with pytest.raises(ValueError, match="name some of"):
            build_rollups(spark, entries(spark, ROWS), new_work_dir(spark, "rollups"), names)


def test_month_pages_read_the_row_groups_of_their_month(spark, monkeypatch):
    monkeypatch.setattr(snapshots.replace, "__defaults__", (*snapshots.replace.__defaults__[:-1], 40))
    rng = random.Random(8)
    rows = [
        (f"p{i % 6}", f"d{i % 5}", ["Fun"], f"{y}-{m:02d}-{1 + rng.randrange(28):02d} 10:10:00", f"{y}-{m:02d}-28 11:00:00")
        for y in (2020, 2021) for m in range(1, 13) for i in range(30)
    ]
    out = new_work_dir(spark, "rollups")
    build_rollups(spark, entries(spark, rows), out)
    page = stored_slice(spark, out, "group", "dayMonthYearCount", "2021", "04")
    plan = plan_of(page)
    assert "EqualTo(month,04)" in plan and "histType=" not in plan.split("Location:")[0]
    files = page.inputFiles()
    assert files and all("histType=dayMonthYearCount/year=2021" in f for f in files)
    groups, of_month, rows_of_month = 0, 0, 0
    for name in files:
        found = pq.ParquetFile(name.removeprefix("file://"))
        at = found.schema_arrow.names.index("month")
        for g in range(found.num_row_groups):
            stats = found.metadata.row_group(g).column(at).statistics
            groups += 1
            if stats.min <= "04" <= stats.max:
                of_month += 1
                rows_of_month += found.metadata.row_group(g).num_rows
    wanted = page.count()
    assert groups >= 8 and of_month <= -(-wanted // 40) + 1 and rows_of_month < wanted + 2 * 41
    read = scanned_rows(page)
    assert wanted <= read <= rows_of_month
    shown = histogram_page(spark, out, "group", "dayMonthYearCount", year="2021", month="04")
    assert shown.count() > 0


def scanned_rows(frame):
    """The rows that the scans of a frame gave to the rest of the plan."""
    found = frame._jdf
    found.collectToPython()
    plan = found.queryExecution().executedPlan()

    def scans(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return scans(node.executedPlan())
        own = int(node.metrics().apply("numOutputRows").value()) if "FileSourceScan" in node.getClass().getName() else 0
        children = node.children()
        return own + sum(scans(children.apply(i)) for i in range(children.size()))

    return scans(plan)
