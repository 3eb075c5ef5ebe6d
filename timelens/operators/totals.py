"""Total time per project, description, tag and per time value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.functions.timeparts import level_text, time_values
from timelens.operators.expand import explode_tags


def concat_key(project: Column, description: Column) -> Column:
    """Display key of a group. Null if either part is null."""
    return F.concat(project, F.lit("|"), description)


def split_key(key: Column) -> tuple[Column, Column]:
    """Project and description of a key: its first two parts; a key without both fails."""
    parts = F.split(key, r"\|", -1)
    checked = F.when(F.size(parts) >= 2, parts).otherwise(
        F.raise_error(F.concat(F.lit("malformed group key: "), key))
    )
    return F.element_at(checked, 1), F.element_at(checked, 2)


def totals(entries: DataFrame, duration: str = "duration") -> DataFrame:
    """Seconds per project, per project and description, and per tag.

    Entries are first added up per (project, description, tags), which is where
    a hot project shrinks; the three kinds of keys are expanded from those sums.
    The parts of a group key travel as columns, so a ``|`` inside a name cannot
    merge two groups.
    """
    pre = entries.groupBy("project", "description", "type").agg(F.sum(duration).alias("seconds"))
    none = F.lit(None).cast("string")

    def key(kind: str, project: Column, description: Column, tag: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("sliceType"),
            project.alias("project"),
            description.alias("description"),
            tag.alias("tag"),
        )

    project, description = F.col("project"), F.col("description")
    keys = F.concat(
        F.array(
            key("project", project, none, none),
            key("project.description", project, description, none),
        ),
        F.transform("type", lambda tag: key("type", none, none, tag)),
    )
    summed = (
        pre.select(F.inline(keys), "seconds")
        .groupBy("sliceType", "project", "description", "tag")
        .agg(F.sum("seconds").alias("totalTime"))
    )
    slice_key = (
        F.when(F.col("sliceType") == "type", F.col("tag"))
        .when(F.col("sliceType") == "project", F.col("project"))
        .otherwise(concat_key(F.col("project"), F.col("description")))
    )
    return summed.select(
        "sliceType", slice_key.alias("sliceKey"), "project", "description", "tag", "totalTime"
    )


def group_totals(entries: DataFrame, duration: str = "duration") -> DataFrame:
    return entries.groupBy("project", "description").agg(F.sum(duration).alias("totalTime"))


def distinct_tags(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct tags per key, combined on the map side, in one exchange."""
    pairs = explode_tags(entries.select(*keys, "type")).select(*keys, "tag")
    return pairs.groupBy(*keys).agg(F.sort_array(F.collect_set("tag")).alias("types"))


def attach_tags(rows: DataFrame, types: DataFrame, keys: list[str]) -> DataFrame:
    """Join tag lists to aggregated rows. Spark picks the join by size."""
    return rows.join(types, keys)


def time_totals(cells: DataFrame) -> DataFrame:
    """Hour rows per value of each time type; for ``year`` the seconds started in it.

    Cells are added up per clock hour first. That leaves at most one row per
    hour of the calendar, and only those rows are expanded to the time types.
    """
    per_hour = cells.groupBy("date", "hour").agg(
        *[F.sum(c).alias(c) for c in ("n", "starts", "started")]
    )
    pairs = [
        F.struct(F.lit(kind).alias("timeType"), value.alias("timeValue"), F.col("n").alias("amount"))
        for kind, value in time_values(F.col("date"), F.col("hour")).items()
    ]
    pairs.append(
        F.struct(
            F.lit("year").alias("timeType"),
            level_text("year", F.year("date")).alias("timeValue"),
            F.when(F.col("starts") > 0, F.col("started")).alias("amount"),
        )
    )
    return (
        per_hour.select(F.inline(F.array(*pairs)))
        .filter(F.col("amount").isNotNull())
        .groupBy("timeType", "timeValue")
        .agg(F.sum("amount").alias("totalTime"))
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of each named table, as one small table."""
    counted = None
    for name, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counted = one if counted is None else counted.unionByName(one)
    return counted
