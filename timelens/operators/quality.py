"""Checks on the rollups. Each returns its violations as (check, key, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.fixed_values import SLICES, TAGS
from timelens.operators.slices import LEVELS


def _violations(rows: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(
        F.lit(check).alias("check"),
        key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def unknown_tags(slices: DataFrame, tags: Sequence[str] = TAGS) -> DataFrame:
    """Tags outside the closed list."""
    bad = slices.filter(~F.col("tag").isin(*tags)).select("tag").distinct()
    return _violations(bad, "unknown tag", F.col("tag"), F.lit(""))


def missing_slices(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities that lack one of the 16 slices."""
    known = F.when(F.col("histType").isin(*SLICES), F.col("histType"))
    bad = slices.groupBy(*keys).agg(F.count_distinct(known).alias("found")).filter(
        F.col("found") < len(SLICES)
    )
    return _violations(bad, "missing slices", F.concat_ws("|", *keys), F.col("found"))


def repeated_keys(rows: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """Keys that occur more than once in a table whose key they are."""
    bad = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    return _violations(bad, f"repeated key in {table}", F.concat_ws("|", *keys), F.col("rows"))


def missing_names(rows: DataFrame, names: Sequence[str], table: str) -> DataFrame:
    """Rows without one of the names that every row of the table must have."""
    bad = None
    for name in names:
        part = _violations(
            rows.filter(F.col(name).isNull()), f"no {name} in {table}", F.lit(name), F.lit("null")
        )
        bad = part if bad is None else bad.unionByName(part)
    return bad.distinct()


def stray_names(rows: DataFrame, names: Sequence[str], table: str) -> DataFrame:
    """Columns a table must not have, such as a description on project rows."""
    stray = [name for name in names if name in rows.columns]
    spark = rows.sparkSession
    return spark.createDataFrame(
        [(f"stray column in {table}", name, "") for name in stray],
        "check string, key string, detail string",
    )


def table_violations(
    rows: DataFrame,
    keys: Sequence[str],
    table: str,
    complete: bool = False,
    known: Sequence[str] | None = None,
) -> DataFrame:
    """Repeated keys, missing names, missing slices and unknown keys of one table.

    One pass: rows are counted per full key, and what is left per entity. The list
    of an entity's repeated keys is bounded by the calendar.
    """
    full = [*keys, "histType", *LEVELS]
    counted = rows.groupBy(*full).agg(F.count(F.lit(1)).alias("rows"))

    def violation(check: str, key: Column, detail: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), key.alias("key"), detail.cast("string").alias("detail")
        )

    again = violation(f"repeated key in {table}", F.concat_ws("|", *full), F.col("rows"))
    slice_name = F.when(F.col("histType").isin(*SLICES), F.col("histType"))
    entities = counted.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("rows") > 1, again)).alias("found"),
        F.size(F.collect_set(slice_name)).alias("slices"),
    )
    checks = [
        F.when(F.col(name).isNull(), violation(f"no {name} in {table}", F.lit(name), F.lit("null")))
        for name in keys
    ]
    if complete:
        short = violation("missing slices", F.concat_ws("|", *keys), F.col("slices"))
        checks.append(F.when(F.col("slices") < len(SLICES), short))
    if known is not None:
        stranger = violation("unknown tag", F.col(keys[0]), F.lit(""))
        checks.append(F.when(~F.col(keys[0]).isin(*known), stranger))
    found = F.concat(F.col("found"), F.array_compact(F.array(*checks)))
    return entities.select(F.inline(found)).distinct()


def rollup_violations(
    projects: DataFrame, groups: DataFrame, tags: DataFrame, tag_names: Sequence[str] = TAGS
) -> DataFrame:
    """All shape checks over the three slice tables; a sound rollup gives no rows."""
    return (
        table_violations(projects, ["project"], "projects")
        .unionByName(table_violations(groups, ["project", "description"], "groups"))
        .unionByName(table_violations(tags, ["tag"], "tags", complete=True, known=tag_names))
        .unionByName(stray_names(projects, ["description"], "projects"))
    )
