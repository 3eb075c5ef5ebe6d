"""Small entry tables for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (project, description, tags, start text, end text) as entries.

    Texts without an offset are read in the session zone.
    """
    made = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)],
        "entry_id long, project string, description string, type array<string>, "
        "s string, e string",
    )
    timed = made.withColumns({"start": F.to_timestamp("s"), "end": F.to_timestamp("e")})
    return timed.withColumn(
        "duration", F.timestamp_diff("SECOND", F.col("start"), F.col("end"))
    ).drop("s", "e")


def texts(rows: DataFrame, *columns: str) -> list[tuple]:
    return sorted(tuple(str(row[c]) for c in columns) for row in rows.select(*columns).collect())
