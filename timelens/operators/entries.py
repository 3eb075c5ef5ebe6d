"""From export rows to clean, tagged entries. All of it is narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.fixed_values import CSV_TIMESTAMP_FORMAT, ISO_FORMAT
from timelens.functions.rules import (
    Rules,
    billable_flag,
    clean_description,
    default_project,
    folded,
    matching_tags,
    or_no_tag,
)

ENTRY_COLUMNS = ("project", "description", "type", "billable", "start", "end", "duration")


def make_timestamp(date: Column, time: Column) -> Column:
    """Local date text and time text to an instant; text that is no date fails the job.

    The failure does not depend on the session's ANSI mode.
    """
    text = F.concat_ws(" ", date, time)
    bad = F.raise_error(F.concat(F.lit("no date and time: "), text)).cast("timestamp")
    return F.coalesce(F.try_to_timestamp(text, F.lit(CSV_TIMESTAMP_FORMAT)), bad)


def duration_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def format_iso(instant: Column) -> Column:
    """ISO-8601 text with the offset of the session zone."""
    return F.date_format(instant, ISO_FORMAT)


def encode_tags(tags: Column) -> Column:
    return F.to_json(tags)


def decode_tags(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def clean_entries(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Default project, cleaned description, 0/1 billable flag.

    The project default comes first, because the cleaning looks at the project.
    """
    project, description = F.col("project"), F.col("description")
    return (
        rows.withColumn("project", default_project(project, description, rules.default_project))
        .withColumn("description", clean_description(project, description, rules.fixes))
        .withColumn("billable", billable_flag(F.col("billable")))
    )


def tag_entries(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Add ``type``: the tags of an entry, ``UNKNOWN`` if no rule matches.

    Folding, rules and default are three steps, because each looks at the result
    of the one before more than once: so every entry is folded and tested once.
    """
    project, description = F.col("project"), F.col("description")
    low = rows.withColumns({"_project": folded(project), "_description": folded(description)})
    found = matching_tags(
        (project, F.col("_project")),
        (description, F.col("_description")),
        rules.project_tags,
        rules.description_tags,
    )
    tagged = low.withColumn("type", found).drop("_project", "_description")
    return tagged.withColumn("type", or_no_tag(F.col("type"), rules.no_tag))


def entries_from_export(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Export rows (see ``sources.csv_entries``) to the entry table."""
    start = make_timestamp(F.col("start_date"), F.col("start_time"))
    end = make_timestamp(F.col("end_date"), F.col("end_time"))
    timed = rows.withColumns({"start": start, "end": end})
    timed = timed.withColumn("duration", duration_seconds(F.col("start"), F.col("end")))
    carried = [c for c in rows.columns if c not in _EXPORT_ONLY]
    return tag_entries(clean_entries(timed, rules), rules).select(
        *[c for c in carried if c not in ENTRY_COLUMNS], *ENTRY_COLUMNS
    )


_EXPORT_ONLY = ("start_date", "start_time", "end_date", "end_time")
