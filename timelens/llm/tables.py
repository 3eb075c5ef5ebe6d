"""Given tables, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that blanks end, as a split pattern and as the characters to strip.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"
#: Words of letters and digits, for lower-cased text.
NOT_ALPHANUMERIC = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends.

    The folder is the one that ``spark.checkpoint.dir`` names, else the one that the
    caller has set with ``setCheckpointDir``; where both are unset it lies below the
    warehouse, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jvm_path)
    files.deleteOnExit(jvm_path)
    return path


def settle(rows: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    What follows starts from files, so a lost executor costs only its own tasks,
    and Spark knows the true size of the table when it chooses joins.
    """
    path = f"{work_dir(rows.sparkSession, name)}/rows"
    rows.write.parquet(path)
    # Spark removes the shuffle files of finished jobs when the driver collects garbage.
    rows.sparkSession._jvm.System.gc()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def discard(rows: DataFrame) -> None:
    """Remove a settled table whose rows no later step reads."""
    spark = rows.sparkSession
    for folder in {name.rpartition("/")[0] for name in rows.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Slots of the filter that ``near`` sends to all tasks.
SLOTS = 1 << 20


def near(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key falls into the same one of ``SLOTS`` slots as a wanted key does.

    Made for wide rows before an exact join with few wanted keys: most others are
    dropped where they are read and need no shuffle. What is sent to all tasks is a
    row for each taken slot, ``SLOTS`` at most; with many more keys than slots all
    rows pass, and none that is wanted is ever dropped.
    """
    return _by_slot(rows, key, wanted, "left_semi")


def far(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """All other rows than those of ``near``: none of them has a wanted key."""
    return _by_slot(rows, key, wanted, "left_anti")


def _by_slot(rows: DataFrame, key: str, wanted: DataFrame, how: str) -> DataFrame:
    def slot(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int")

    taken = F.broadcast(wanted.select(slot(key).alias("_slot")).distinct())
    marked = rows.withColumn("_of_slot", slot(key))
    return marked.join(taken, F.col("_of_slot") == F.col("_slot"), how).drop("_of_slot")


#: Copies of one row that are made in one task, at most.
CHUNK = 1000


def numbered_copies(rows: DataFrame, stored: DataFrame, copies: str, number: str, key: Sequence[str]) -> DataFrame:
    """Every row ``copies`` times, with ``number`` from 0.

    A row of many copies is cut into chunks, which are dealt to other tasks before the
    copies are made. ``stored`` is a table that has the same numbers of copies: whether
    there is such a row at all is looked up there, and usually there is none.
    """
    zero, last = F.lit(0).cast("bigint"), F.col(copies) - 1
    few = rows.filter(F.col(copies) <= CHUNK).withColumn(number, F.explode(F.sequence(zero, last)))
    if stored.filter(F.col(copies) > CHUNK).isEmpty():
        return few
    chunks = F.explode(F.sequence(zero, F.floor(last / CHUNK)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = rows.filter(F.col(copies) > CHUNK).withColumn("_chunk", chunks).repartition(parts, *key, "_chunk")
    inside = F.sequence(F.col("_chunk") * CHUNK, F.least(last, (F.col("_chunk") + 1) * CHUNK - 1))
    return few.unionByName(many.withColumn(number, F.explode(inside)).drop("_chunk"))


def blank_words(text: Column) -> Column:
    """Words between blanks, unchanged; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARACTERS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged; null becomes empty.

    Translating goes character by character; texts of ASCII alone have a faster way.
    """
    upper, given = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(given) == F.length(given)
    return F.when(ascii_only, F.lower(given)).otherwise(F.translate(given, upper, upper.lower()))


def alphanumeric_words(text: Column) -> Column:
    """Words of letters and digits of the lower-cased text."""
    return F.array_remove(F.split(lower_ascii(text), NOT_ALPHANUMERIC), "")


def unit_draw(*parts: Column) -> Column:
    """A number between 0 and 1 (neither of them) from the MD5 of the joined parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def key_text(key: Column) -> Column:
    """A key as text; a null key counts as the empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))
