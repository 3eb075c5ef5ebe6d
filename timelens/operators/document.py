"""The result document, one JSON row per entity.

A single document would have to pass through one task. Its sections are tables
instead: every time type, tag, group and project is one row with its JSON text,
and the totals maps are one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.functions.labels import time_label
from timelens.operators.nesting import json_object


def _row(section: Column, entity: Column, json: Column, names: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a section row; names of a project or group are columns of their own."""
    none = F.lit(None).cast("string")
    carried = [(F.col(n) if n in names else none).alias(n) for n in ("project", "description")]
    return [section.alias("section"), entity.alias("entity"), *carried, json.alias("json")]


def labelled_times(totals: DataFrame, compat: bool = False) -> DataFrame:
    label = time_label(F.col("timeType"), F.col("timeValue"), compat)
    return totals.withColumn("timeString", label)


def by_time(labelled: DataFrame, section: str, by_total: bool = False) -> DataFrame:
    """Per time type the list of {totalTime, timeString, originalTime}.

    Lists are bounded by the calendar. ``by_total`` orders by descending total,
    otherwise values ascend.
    """
    total, value = F.col("totalTime"), F.col("timeValue")
    rank = F.struct((-total).alias("r"), value.alias("v")) if by_total else F.struct(value.alias("v"))
    item = F.struct(total, F.col("timeString"), value.alias("originalTime"))
    pairs = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), item.alias("item"))))
    items = F.transform(pairs, lambda p: p["item"])
    return labelled.groupBy("timeType").agg(F.to_json(items).alias("json")).select(
        *_row(F.lit(section), F.col("timeType"), F.col("json"))
    )


def _slices_object() -> Column:
    """All slices of an entity as one JSON object, at most 16 members."""
    pairs = F.collect_list(F.struct(F.col("histType").alias("k"), F.col("hist").alias("v")))
    return json_object(F.array_sort(pairs))


def by_tag(hists: DataFrame) -> DataFrame:
    """Tag to slice to histogram."""
    return hists.groupBy("tag").agg(_slices_object().alias("json")).select(
        *_row(F.lit("byType.all"), F.col("tag"), F.col("json"))
    )


def by_entity(hists: DataFrame, keys: list[str], section: str) -> DataFrame:
    """One record per project or group: its names, its tags, its histograms.

    The slices are JSON text already, so their members are set behind those of
    the record.
    """
    record = hists.groupBy(*keys).agg(
        F.first("types").alias("type"), _slices_object().alias("slices")
    )
    head = F.to_json(F.struct(*keys, "type"))
    json = F.concat(
        F.regexp_replace(head, r"\}\z", ","), F.expr("substring(slices, 2)")
    )
    return record.select(*_row(F.lit(section), F.concat_ws("|", *keys), json, tuple(keys)))


def totals_sections(totals: DataFrame) -> DataFrame:
    """The three totals maps, one row per key."""
    section = (
        F.when(F.col("sliceType") == "project", "byProject.totals")
        .when(F.col("sliceType") == "project.description", "byGroup.totals")
        .otherwise("byType.totals")
    )
    json = F.col("totalTime").cast("string")
    return totals.select(*_row(section, F.col("sliceKey"), json, ("project", "description")))
