"""Tables on shared storage: checked writes that replace a table in one step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from timelens.sources.snapshots import Written, found_rows, has_versions, publish, replace, snapshot, table

ROWS = "rows"


def write_table(
    rows: DataFrame, path: str, partition_by: Sequence[str] = (), check: bool = False
) -> Written:
    """Replace the table at ``path``; returns what was handed to the writer.

    The count and the content are observed during the write, so they cost no second
    scan. Readers see the old rows until the new ones are complete; with ``check`` the
    new files are read and compared before they take the old ones' place.
    """
    spark = rows.sparkSession
    after, written = replace(snapshot(spark, path), ROWS, rows, partition_by)
    if check:
        compare(table(spark, after, ROWS), path, written)
    publish(spark, after)
    return written


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the table, or plain Parquet where there are no versions."""
    if not has_versions(spark, path):
        return spark.read.parquet(path)
    return table(spark, snapshot(spark, path), ROWS)


def compare(rows: DataFrame, name: str, expected: Written) -> None:
    """Fail unless these are the rows that were handed to the writer, in any order.

    Counts alone miss a lost row beside a doubled one; the sum of hashes does not.
    """
    found = found_rows(rows)
    if found != expected:
        raise ValueError(f"{name}: wrote {expected}, found {found}")


def check_written(spark: SparkSession, path: str, expected: Written) -> None:
    """Fail unless the table holds exactly the rows that were handed to the writer."""
    compare(read_table(spark, path), path, expected)


DOCUMENT_SCHEMA = "entity string, project string, description string, json string, section string"


def write_documents(rows: DataFrame, path: str) -> None:
    """JSON lines, one folder per section, rebalanced so that no task writes slivers of all."""
    rows = rows.hint("rebalance", "section")
    rows.write.mode("overwrite").partitionBy("section").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_SCHEMA).json(path)
