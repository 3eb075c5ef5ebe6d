"""Tidy slice rows to nested histograms, as maps or as JSON text.

The rows of one entity are few: its slices have at most one row per year,
month, weekday and hour. So rows are hashed by entity and slice once, and every
further level groups on more columns than that and needs no exchange of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.fixed_values import SLICES
from timelens.operators.slices import LEVELS, measure_names


def _by_key(pairs: Column) -> Column:
    """Pairs in key order; a comparator, because values may be maps, which have no order."""
    return F.array_sort(
        pairs,
        lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0),
    )


def nested_maps(rows: DataFrame, keys: Sequence[str], slice_type: str) -> DataFrame:
    """One slice as ``hist``: a map per level, outermost first, keys ascending."""
    levels = list(SLICES[slice_type])
    names = measure_names(slice_type)
    leaf = F.col(names[0]) if len(names) == 1 else F.struct(*names)
    nested = rows.select(*keys, *levels, leaf.alias("hist")).repartition(*keys)
    while levels:
        inner = levels.pop()
        pairs = F.collect_list(F.struct(F.col(inner).alias("k"), F.col("hist").alias("v")))
        nested = nested.groupBy(*keys, *levels).agg(
            F.map_from_entries(_by_key(pairs)).alias("hist")
        )
    return nested


def hist_json(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All slices of every entity as (keys, histType, hist JSON text), keys ascending.

    Takes the table of ``all_slices``. One pass folds the levels from the
    innermost outwards; a level a slice does not have is null and is passed over.
    """
    leaf = (
        F.when(F.col("histType") == "yearSum", F.col("totalTime").cast("string"))
        .when(F.col("count").isNull(), F.col("hourCount").cast("string"))
        .otherwise(F.to_json(F.struct("count", "hourCount")))
    )
    folded = slices.select(*keys, "histType", *LEVELS, leaf.alias("hist")).repartition(*keys, "histType")
    outer = list(LEVELS)
    while outer:
        inner = outer.pop()
        pairs = F.collect_list(F.struct(F.col(inner).alias("k"), F.col("hist").alias("v")))
        folded = folded.groupBy(*keys, "histType", *outer).agg(
            F.when(F.max(inner).isNull(), F.first("hist"))
            .otherwise(json_object(F.array_sort(pairs)))
            .alias("hist")
        )
    return folded


def json_object(pairs: Column) -> Column:
    """JSON object text from (k text, v JSON text) pairs; keys need no escaping."""
    members = F.transform(
        pairs, lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), p["v"])
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
