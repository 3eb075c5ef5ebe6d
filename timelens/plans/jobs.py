"""The three batch jobs: export to entries, entries to rollups, rollups to document."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from timelens.functions.rules import Rules
from timelens.operators.document import by_entity, by_tag, by_time, labelled_times, totals_sections
from timelens.operators.entries import entries_from_export
from timelens.operators.nesting import hist_json
from timelens.operators.ranking import top_per_time_type
from timelens.operators.slices import BASE_KEYS, hour_cells, rollup_base, tag_cells
from timelens.operators.states import (
    YEARLESS,
    YEARLY,
    cell_state,
    clock_state,
    day_state,
    merged_days,
    merged_sums,
    merged_tags,
    tag_state,
    year_text,
    yearless_slices,
    yearly_slices,
)
from timelens.operators.totals import attach_tags, time_totals, totals
from timelens.session import new_work_dir
from timelens.sources.csv_entries import scan_csv
from timelens.sources.snapshots import Snapshot, Written, publish, replace, snapshot, table
from timelens.sources.tables import write_documents, write_table


#: The rollup table of projects, groups and tags. Its slices are in ``slices_<name>``, the
#: states they come from in ``cells_<name>`` and ``days_<name>``, tag lists in ``types_<name>``.
ROLLUP_TABLES = {"project": "totalsProject", "group": "totalsGrouped", "tag": "totalsTyped"}
ROLLUP_KEYS = {
    "totalsProject": ["project"],
    "totalsGrouped": ["project", "description"],
    "totalsTyped": ["tag"],
}
#: What can be built by itself; the last two need no slices.
ROLLUPS = (*ROLLUP_KEYS, "totals", "totalsTime")


def process_exports(
    spark: SparkSession,
    paths: str | Sequence[str],
    out: str,
    multiline: bool = False,
    rules: Rules = Rules(),
) -> Written:
    """CSV exports to the entry table, cleaned and tagged by ``rules``. One narrow stage.

    The new table is compared with what was handed to the writer, and only then takes
    the old one's place.
    """
    entries = entries_from_export(scan_csv(spark, paths, multiline), rules)
    return write_table(entries, out, check=True)


def build_rollups(
    spark: SparkSession, entries: DataFrame, out: str, names: Sequence[str] = ROLLUPS
) -> dict[str, int]:
    """Entries to the rollup tables below ``out``, in place of any that are there.

    All of ``ROLLUPS`` are built, or only the named ones: totals and time totals by
    themselves are a fraction of the work, for they need no slices. Returns the rows of
    each table. Readers see the old tables until all are written.
    """
    unknown = set(names) - set(ROLLUPS)
    if unknown or not names:
        raise ValueError(f"no rollups {sorted(unknown)}: name some of {ROLLUPS}")
    before = snapshot(spark, out)
    return _add(spark, entries, before._replace(tables={}, batches=()), None, names)


def add_entries(
    spark: SparkSession, entries: DataFrame, out: str, batch: str | None = None
) -> dict[str, int]:
    """Add entries, such as the export of one more year, to the rollups below ``out``.

    The result is that of ``build_rollups`` over all entries; where there are no rollups
    yet, they are built, and where only some were built, those are kept up. The stored states and
    slices of years that the new entries do not touch are neither read for it nor
    written. Slices without a year add up the stored ones of all years; histograms as
    JSON and time totals are made anew from the slices and the clock. A batch that has
    been added before is refused. Returns the rows written to each table.
    """
    before = snapshot(spark, out)
    if batch is not None and batch in before.batches:
        raise ValueError(f"{out}: the batch {batch} has been added before")
    names = [name for name in ROLLUPS if name in before.tables]
    return _add(spark, entries, before, batch, names or ROLLUPS)


def _add(
    spark: SparkSession, entries: DataFrame, before: Snapshot, batch: str | None, names: Sequence[str]
) -> dict[str, int]:
    """Merge entries into the named tables of a version and publish the next one.

    For slices the new entries are aggregated once and written; everything after starts
    from tables on shared storage, whatever happens to executors meanwhile. Totals and time
    totals alone add the fanned-out hours up as they come: a few rows a task are shuffled.
    Projects, groups, tags and the two totals do not depend on each other, so their writes
    run side by side.
    """
    chains = [{"totals": _add_totals, "totalsTime": _add_times}[n] for n in names if n not in ROLLUP_KEYS]
    if len(chains) == len(names):
        base = hour_cells(entries, BASE_KEYS)
    else:
        work = new_work_dir(spark, "base")
        rollup_base(entries).write.parquet(work)
        base = spark.read.parquet(work)
        # As many as the calendar has.
        years = [r.year for r in base.select(year_text().alias("year")).distinct().collect()]
        chains = [partial(_add_slices, name=n, years=years) for n in names if n in ROLLUP_KEYS] + chains
    with ThreadPoolExecutor(len(chains)) as pool:
        running = [pool.submit(chain, Draft(spark, before), base) for chain in chains]
        drafts = [r.result() for r in running]
    tables, counts = dict(before.tables), {}
    for draft in drafts:
        tables |= {name: draft.tables.tables[name] for name in draft.counts}
        counts |= draft.counts
    publish(spark, before._replace(tables=tables), batch)
    return counts


class Draft:
    """Tables of a version together with what has been written since, but not published."""

    def __init__(self, spark: SparkSession, tables: Snapshot) -> None:
        self.spark, self.tables = spark, tables
        self.counts: dict[str, int] = {}

    def store(self, name: str, rows: DataFrame, *args, **options) -> None:
        self.tables, written = replace(self.tables, name, rows, *args, **options)
        self.counts[name] = self.counts.get(name, 0) + written.rows

    def stored(self, name: str, choice: dict | None = None) -> DataFrame:
        return table(self.spark, self.tables, name, choice or {})

    def with_stored(self, name: str, new: DataFrame, choice: dict | None = None) -> DataFrame:
        return self.stored(name, choice).unionByName(new) if name in self.tables.tables else new


def _add_slices(draft: Draft, base: DataFrame, name: str, years: Sequence[str]) -> Draft:
    """States, slices, tag lists and histograms of projects, groups or tags."""
    keys, touched = ROLLUP_KEYS[name], {"year": years}
    cells = tag_cells(base) if keys == ["tag"] else base
    sums = draft.with_stored(f"cells_{name}", cell_state(cells, keys), touched)
    draft.store(f"cells_{name}", merged_sums(sums, ["n", "seconds"]), ["year"], only=touched)
    days = draft.with_stored(f"days_{name}", day_state(cells, keys), touched)
    draft.store(f"days_{name}", merged_days(days), ["year"], only=touched)

    slices, by = f"slices_{name}", ["histType", "year"]
    order = ["month", *keys, "day", "hour"]
    states = [draft.stored(f"{state}_{name}", touched) for state in ("cells", "days")]
    yearly = {**touched, "histType": YEARLY}
    draft.store(slices, yearly_slices(*states, keys), by, order, only=yearly)
    of_all_years = draft.stored(slices, {"histType": tuple(YEARLESS.values())})
    yearless = {"histType": tuple(YEARLESS)}
    draft.store(slices, yearless_slices(of_all_years, keys), by, order, only=yearless)

    hists = hist_json(draft.stored(slices), keys)
    if keys != ["tag"]:
        types = draft.with_stored(f"types_{name}", tag_state(base, keys))
        draft.store(f"types_{name}", merged_tags(types))
        hists = attach_tags(hists, draft.stored(f"types_{name}"), keys)
    draft.store(name, hists, ["histType"])
    return draft


def _add_totals(draft: Draft, base: DataFrame) -> Draft:
    summed = draft.with_stored("totals", totals(base, "started"))
    draft.store("totals", merged_sums(summed, ["totalTime"]))
    return draft


def _add_times(draft: Draft, base: DataFrame) -> Draft:
    """The time totals by way of the clock."""
    clock = draft.with_stored("clock", clock_state(base))
    draft.store("clock", merged_sums(clock, ["n", "starts", "started"]))
    draft.store("totalsTime", time_totals(draft.stored("clock")))
    return draft


def rollup_table(
    spark: SparkSession, rollups: str, name: str, choice: dict | None = None
) -> DataFrame:
    """A stored rollup table, or its partitions with the chosen values."""
    return table(spark, snapshot(spark, rollups), name, choice or {})


def build_document(
    spark: SparkSession, rollups: str, out: str, compat_labels: bool = False
) -> None:
    """Rollup tables of one version to the sections of the result document, as JSON lines."""
    tables = snapshot(spark, rollups)
    names = ("totalsTime", "totalsTyped", "totalsGrouped", "totalsProject", "totals")
    rows = document_rows(*[table(spark, tables, name) for name in names], compat_labels)
    write_documents(rows, out)


def document_rows(
    times: DataFrame,
    tag_hists: DataFrame,
    group_hists: DataFrame,
    project_hists: DataFrame,
    total_rows: DataFrame,
    compat_labels: bool = False,
) -> DataFrame:
    """All sections as (section, entity, json)."""
    labelled = labelled_times(times, compat_labels)
    top = top_per_time_type(labelled)
    sections = [
        by_time(top, "byTime.top", by_total=True),
        by_time(labelled, "byTime.all"),
        by_tag(tag_hists),
        by_entity(group_hists, ["project", "description"], "byGroup.all"),
        by_entity(project_hists, ["project"], "byProject.all"),
        totals_sections(total_rows),
    ]
    rows = sections[0]
    for section in sections[1:]:
        rows = rows.unionByName(section)
    return rows
