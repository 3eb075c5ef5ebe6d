"""The chart pages: stored rollups in, the rows of one chart out.

A page reads the one partition of the slice table that it shows, below the year and
month it shows. The ``live_`` functions answer from the entries, without rollups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.fixed_values import SLICES
from timelens.functions.labels import axis_label, count_label, duration_label, hours_label
from timelens.operators.calendar import (
    calendar_heatmap,
    day_totals,
    intensity_bins,
    year_periods,
)
from timelens.operators.expand import touching
from timelens.operators.hierarchy import share_extents
from timelens.operators.ranking import best_recent_year
from timelens.operators.series import (
    axis_keys,
    check_options,
    fill_series,
    group_name,
    known_tags,
    select_slice,
    series_rows,
    winner_series,
    years_of,
)
from timelens.operators.slices import hour_cells, slice_rows, tag_cells
from timelens.operators.totals import group_totals, time_totals
from timelens.plans.jobs import ROLLUP_TABLES, rollup_table

KEYS = {"project": ["project"], "group": ["project", "description"], "tag": ["tag"]}


def slice_cells(
    entries: DataFrame, kind: str, year: str | None = None, month: str | None = None
) -> DataFrame:
    """Cells of projects, groups or tags, restricted to a year and month if given."""
    source = touching(entries, year, month)
    carried = ["type"] if kind == "tag" else KEYS[kind]
    cells = hour_cells(source, carried)
    if year is not None:
        cells = cells.filter(F.year("date") == int(year))
    if month is not None:
        cells = cells.filter(F.month("date") == int(month))
    return tag_cells(cells) if kind == "tag" else cells


def live_slice(
    entries: DataFrame,
    kind: str,
    slice_type: str,
    year: str | None = None,
    month: str | None = None,
) -> DataFrame:
    """Rows of one slice straight from the entries, those of the given year and month."""
    options = check_options(slice_type, year, month)
    cells = slice_cells(entries, kind, options.get("year"), options.get("month"))
    return slice_rows(cells, KEYS[kind], slice_type)


def stored_slice(
    spark: SparkSession,
    rollups: str,
    kind: str,
    slice_type: str,
    year: str | None = None,
    month: str | None = None,
) -> DataFrame:
    """Rows of one slice from the stored rollups, those of the given year and month.

    Slice and year are partitions, and only their folders are listed. Inside a
    partition rows are sorted by month, so the statistics of row groups skip the rest.
    """
    choice = {"histType": [slice_type]}
    if year is not None and "year" in SLICES[slice_type]:
        choice["year"] = [year]
    rows = rollup_table(spark, rollups, f"slices_{ROLLUP_TABLES[kind]}", choice)
    if month is not None and "month" in SLICES[slice_type]:
        rows = rows.filter(F.col("month") == month)
    return rows


def chart_series(
    rows: DataFrame,
    kind: str,
    slice_type: str,
    year: str | None = None,
    month: str | None = None,
    count_type: str = "hourCount",
    years: Sequence[str] | None = None,
    tags: Sequence[str] | None = None,
    convert: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, tuple[str, ...]]:
    """Filled series of one slice, and the keys of their axis.

    A year axis has the years of the data unless others are given. All tags are
    shown unless a list is given; then ``tag_order`` is a tag's place in it.
    ``convert`` maps every value, the zeros of empty buckets included.
    """
    leaves = select_slice(rows, KEYS[kind], slice_type, year, month, count_type)
    if years is None and SLICES[slice_type][-1] == "year":
        years = years_of(leaves)
    axis = axis_keys(slice_type, years or ())
    series = fill_series(leaves, KEYS[kind], axis, convert)
    return (known_tags(series, tags) if kind == "tag" and tags is not None else series), axis


def series_name(kind: str) -> Column:
    if kind == "group":
        return group_name(F.col("project"), F.col("description"))
    return F.col("tag" if kind == "tag" else "project")


def histogram_bars(rows: DataFrame, kind: str, slice_type: str, **options) -> DataFrame:
    """Bars of a histogram: name, bucket, axis label, value, value label.

    Takes the options of ``chart_series``. A tag's place comes along if a list of
    tags is given.
    """
    series, axis = chart_series(rows, kind, slice_type, **options)
    keys = [*KEYS[kind], *(["tag_order"] if "tag_order" in series.columns else [])]
    bars = series_rows(winner_series(series, axis), keys, axis)
    shown = duration_label if slice_type == "yearSum" else count_label
    return bars.select(
        *keys,
        series_name(kind).alias("name"),
        "bucket",
        axis_label(SLICES[slice_type][-1], F.col("bucket")).alias("label"),
        "value",
        shown(F.col("value")).alias("value_label"),
    )


def histogram_page(
    spark: SparkSession, rollups: str, kind: str, slice_type: str, **options
) -> DataFrame:
    """Bars of one histogram page from the stored rollups; options as ``chart_series``."""
    chosen = check_options(slice_type, options.get("year"), options.get("month"))
    rows = stored_slice(spark, rollups, kind, slice_type, **chosen)
    return histogram_bars(rows, kind, slice_type, **options)


def live_histogram_page(
    entries: DataFrame,
    kind: str,
    slice_type: str,
    year: str | None = None,
    month: str | None = None,
    **options,
) -> DataFrame:
    """The same bars from the entries."""
    rows = live_slice(entries, kind, slice_type, year, month)
    return histogram_bars(rows, kind, slice_type, year=year, month=month, **options)


def heatmap_days(totals: DataFrame) -> DataFrame:
    """Calendar heatmap of the best recent year out of the time totals."""
    periods = year_periods(best_recent_year(totals))
    heatmap = intensity_bins(calendar_heatmap(day_totals(totals), periods))
    return heatmap.select(
        "date", "week_start", "dow", "hours", "bin", hours_label(F.col("hours")).alias("label")
    )


def heatmap_page(spark: SparkSession, rollups: str) -> DataFrame:
    return heatmap_days(rollup_table(spark, rollups, "totalsTime"))


def live_heatmap_page(entries: DataFrame) -> DataFrame:
    return heatmap_days(time_totals(hour_cells(entries, [])))


def stored_groups(spark: SparkSession, rollups: str) -> DataFrame:
    totals = rollup_table(spark, rollups, "totals")
    groups = totals.filter(F.col("sliceType") == "project.description")
    return groups.select("project", "description", "totalTime")


def sunburst_page(spark: SparkSession, rollups: str, extent: float = 1.0) -> DataFrame:
    """Totals of the hierarchy with the share interval of every node.

    Runs jobs over the stored group totals when called.
    """
    return share_extents(stored_groups(spark, rollups), extent)


def live_sunburst_page(entries: DataFrame, extent: float = 1.0) -> DataFrame:
    """The same from the entries, which are read several times."""
    return share_extents(group_totals(entries), extent)
