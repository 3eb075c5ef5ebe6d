"""Weighted rendezvous hashing of record keys over shards, with a slot in each shard.

Every (key, shard) pair draws a number from the key and the shard alone; a record
goes to the shard with the smallest ``-ln(draw) / weight``. A new shard draws for
itself and leaves all other draws alone, so it only takes records and moves none
between old shards.

Empty tables give empty results. A null key counts as the empty text, a null text
has no bytes; records alike in key, size and checksum are as many rows as before,
in successive slots. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timelens.llm.tables import key_text, numbered_copies, settle, unit_draw

WEIGHTS = (1.0,) * 8
GROWN_BY = 1.0


def distances(key: Column, weights: Sequence[float]) -> list[Column]:
    """What each shard bids for a key, the lowest bid first to win."""
    return [
        F.struct(
            (-F.ln(unit_draw(key_text(key), F.lit(str(shard)))) / float(weight)).alias("distance"),
            F.lit(shard).alias("shard"),
        )
        for shard, weight in enumerate(weights)
        if weight > 0
    ]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; shards of weight 0 get nothing."""
    return F.array_min(F.array(*distances(key, weights)))["shard"]


def with_slots(records: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the rows of every ``shard`` from 0 without gaps.

    ``records`` has a ``shard`` and a ``copies`` column; rows are unique in ``order``.
    Each shard is cut into about the square root of its rows many slices by hash, so
    neither the rows of a slice nor the slices of a shard become a large group. A row
    of many copies is dealt out before its copies are made.
    """
    n = records.count()
    slices = max(1, math.isqrt(max(1, n // max(1, len(WEIGHTS)))))
    text = [key_text(F.col(c)) for c in order]
    cut = records.withColumn("slice", F.floor(unit_draw(*text, F.lit("slot")) * slices).cast("int"))
    rows = cut.groupBy("shard", "slice").agg(F.sum("copies").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select(
        "shard", "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset")
    )
    inside = (
        Window.partitionBy("shard", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = cut.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(
        offsets, ["shard", "slice"]
    )
    copied = numbered_copies(placed, records, "copies", "copy", order)
    return copied.withColumn("slot", F.col("offset") + F.col("inside") + F.col("copy"))


def shard_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, grown_by: float = GROWN_BY
) -> DataFrame:
    """Shard and slot of every document, and its shard once one more shard is added.

    Counts the documents and writes a narrow intermediate table when called.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    records = (
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", rendezvous(F.col("doc_id"), weights))
        .withColumn("grown_shard", rendezvous(F.col("doc_id"), [*weights, grown_by]))
    )
    slotted = with_slots(settle(records, "shards"), ["doc_id", "size", "text_crc32"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
