"""Time-entry exports as CSV, read and written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.fixed_values import CSV_COLUMNS

_USED = {
    "Project": "project",
    "Description": "description",
    "Billable": "billable",
    "Start date": "start_date",
    "Start time": "start_time",
    "End date": "end_date",
    "End time": "end_time",
}


def scan_csv(
    spark: SparkSession, paths: str | Sequence[str], multiline: bool = False
) -> DataFrame:
    """Read one or many exports; columns count by position, the header is skipped.

    A malformed row fails the job. For that all 13 columns are parsed: with
    column pruning Spark would not notice a row of the wrong width. Empty text
    stays empty text. ``multiline`` allows line breaks inside quoted fields, at
    the price of one task per file.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in CSV_COLUMNS])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("columnPruning", False)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    return rows.select(
        *[F.coalesce(F.col(name), F.lit("")).alias(alias) for name, alias in _USED.items()]
    )


def write_csv(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write export columns as CSV with a header, one folder per partition value."""
    writer = rows.write.mode("overwrite").option("header", True).option("escape", '"')
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.csv(path)
