"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelens.llm.tables import settle


def _smallest(links: DataFrame) -> DataFrame:
    """For every left end the smallest of it and its right ends."""
    return links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link all larger neighbours of a node to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        both.join(_smallest(both), "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = down.join(_smallest(down), "a")
    return (
        found.select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(found.select("a", F.col("least").alias("b")))
        .filter("a <> b")
        .distinct()
    )


def _state(links: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reached) of all linked nodes.

    Each round is written to the shared folder. It ends when a round changes nothing,
    after about the logarithm of the longest path many rounds.
    """
    current = settle(links.select("a", "b").filter("a <> b").distinct(), "links")
    state = _state(current)
    while state[0]:
        current = settle(_small_star(_large_star(current)), "links")
        after = _state(current)
        if after == state:
            break
        state = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(centres)
