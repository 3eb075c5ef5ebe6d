"""Hashes of word runs as array columns, by doubling, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _paired(left: Column, right: Column, step: int, combine) -> Column:
    """Each value of ``left`` with the one ``step`` places later in ``right``."""
    length = F.least(F.size(left), F.greatest(F.size(right) - step, F.lit(0)))
    return F.zip_with(F.slice(left, F.lit(1), length), F.slice(right, F.lit(step + 1), length), combine)


def joined(left: Column, right: Column, step: int) -> Column:
    """Hashes of the run at each place and the run ``step`` places later."""
    return _paired(left, right, step, lambda a, b: F.xxhash64(a, b))


def smaller(left: Column, right: Column, step: int) -> Column:
    return _paired(left, right, step, lambda a, b: F.least(a, b))


def add_runs(rows: DataFrame, size: int, combine, prefix: str) -> DataFrame:
    """Add the column ``prefix<size>`` to rows that have ``prefix1``, by doubling.

    Every step is a column of its own, so none is evaluated twice; steps that an
    earlier call has added are used again.
    """

    def step(rows: DataFrame, have: int, more: int) -> DataFrame:
        name = f"{prefix}{have + more}"
        if name in rows.columns:
            return rows
        return rows.withColumn(name, combine(F.col(f"{prefix}{have}"), F.col(f"{prefix}{more}"), have))

    made = [1]
    while made[-1] * 2 <= size:
        rows = step(rows, made[-1], made[-1])
        made.append(made[-1] * 2)
    have = made[-1]
    while have < size:
        more = max(m for m in made if m <= size - have)
        rows = step(rows, have, more)
        have += more
    return rows
