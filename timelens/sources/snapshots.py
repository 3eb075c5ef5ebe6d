"""Sets of tables that change in one step.

The tables of a set lie below one root. Every write makes a folder of its own, and a
small numbered file in ``_versions`` names the folders that belong to each table. A
reader takes the newest file once and keeps to it, so it goes on reading the folders it
has seen; a write that fails leaves folders that no version names. Partitions that a
change does not touch are named again as they are: their files are neither read nor
written.

A version is written under another name and renamed, and only if no newer one has come
meanwhile. One writer at a time is assumed where the storage cannot rename in one step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONS = "_versions"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Rows of a Parquet row group in sorted tables: what a narrow read takes at least.
ROW_GROUP_ROWS = 1 << 17


class Written(NamedTuple):
    """What a writer was handed: the number of rows, and the sum of their hashes."""

    rows: int
    content: int


class Table(NamedTuple):
    """A table of a version: where each partition lies, below the folder of which write."""

    schema: str
    partition_by: tuple[str, ...]
    form: str
    parts: Mapping[str, str]


class Snapshot(NamedTuple):
    """One version of the tables below ``root``; number 0 has none."""

    root: str
    number: int
    tables: Mapping[str, Table]
    batches: tuple[str, ...] = ()


def _files(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def has_versions(spark: SparkSession, root: str) -> bool:
    files, at = _files(spark, f"{root}/{VERSIONS}")
    return files.exists(at)


def version_numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    found = (n.removesuffix(".json") for n in _names(spark, f"{root}/{VERSIONS}") if n.endswith(".json"))
    return sorted(int(n) for n in found if n.isdigit())


def _version_path(root: str, number: int) -> str:
    return f"{root}/{VERSIONS}/{number:08d}.json"


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    """A version of the tables below ``root``, the newest unless a number is given."""
    root = root.rstrip("/")
    if number is None:
        number = max(version_numbers(spark, root), default=0)
    if number == 0:
        return Snapshot(root, 0, {})
    files, at = _files(spark, _version_path(root, number))
    stream = files.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    found = json.loads(text)
    tables = {
        name: Table(t["schema"], tuple(t["partition_by"]), t["form"], t["parts"]) for name, t in found["tables"].items()
    }
    return Snapshot(root, number, tables, tuple(found["batches"]))


def _part_values(part: str) -> dict[str, str | None]:
    pairs = (level.split("=", 1) for level in part.split("/") if level)
    return {name: None if value == NO_VALUE else value for name, value in pairs}


Choice = Mapping[str, Collection[str | None]]


def _chosen(part: str, choice: Choice) -> bool:
    values = _part_values(part)
    return all(values[column] in wanted for column, wanted in choice.items())


def table(spark: SparkSession, tables: Snapshot, name: str, choice: Choice = {}) -> DataFrame:
    """A table of a version, or those of its partitions that have the chosen values.

    Partitions are chosen by the version file, so the others are not even listed.
    Values of partitions are plain texts without ``/``, ``=`` and ``%``.
    """
    found = tables.tables[name]
    schema = T.StructType.fromJson(json.loads(found.schema))
    base = f"{tables.root}/{name}"
    folders = [f"{base}/{write}/{part}" for part, write in found.parts.items() if _chosen(part, choice)]
    if not folders:
        return spark.createDataFrame([], schema)
    with_write = T.StructType([*schema.fields, T.StructField("write", T.StringType())])
    reader = spark.read.schema(with_write).format(found.form).option("basePath", base)
    return reader.load(folders).select(*schema.names)


def _leaves(spark: SparkSession, path: str, depth: int) -> list[str]:
    """Relative paths of the partitions below a folder."""
    found = [""]
    for _ in range(depth):
        found = [f"{at}/{n}".lstrip("/") for at in found for n in _names(spark, f"{path}/{at}") if "=" in n]
    return found


def row_content(rows: DataFrame) -> Column:
    """The sum of the hashes of all rows: the same for the same rows in any order."""
    return F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(20,0)"))


def _observed(rows: DataFrame, seen: Observation) -> DataFrame:
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), row_content(rows).alias("content"))


def found_rows(rows: DataFrame) -> Written:
    """The number of rows and the sum of their hashes, in one pass."""
    row = rows.agg(F.count(F.lit(1)).alias("rows"), row_content(rows).alias("content")).first()
    return Written(row.rows, int(row.content or 0))


def replace(
    tables: Snapshot,
    name: str,
    rows: DataFrame,
    partition_by: Sequence[str] = (),
    order: Sequence[str] = (),
    only: Choice | None = None,
    form: str = "parquet",
    row_group_rows: int = ROW_GROUP_ROWS,
) -> tuple[Snapshot, Written]:
    """Write rows as a table, and name them in a version that is not published yet.

    ``only`` keeps all partitions that do not have the given values. A partitioned table
    is rebalanced, which splits large partitions and merges small ones. With ``order``
    rows are clustered: those that agree in partition and first column of the order go to
    one task, or to several where they are many, and each task sorts its own, so the
    statistics of row groups let narrow reads skip. No bounds are looked for, so no rows
    are sampled to the driver. Partition columns must be text; all columns but these may
    hold anything.
    """
    spark, seen = rows.sparkSession, Observation()
    before = tables.tables.get(name)
    keys = tuple(partition_by)
    if only is not None and before is not None and (before.partition_by, before.form) != (keys, form):
        raise ValueError(f"{name} is stored by {before.partition_by} as {before.form}")
    if order:
        rows = rows.hint("rebalance", *keys, order[0]).sortWithinPartitions(*keys, *order)
    elif keys:
        rows = rows.hint("rebalance", *keys)
    write = f"write={uuid.uuid4().hex}"
    folder = f"{tables.root}/{name}/{write}"
    writer = _observed(rows, seen).write.format(form)
    if order and form == "parquet":
        writer = writer.option("parquet.block.row.count.limit", row_group_rows)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.save(folder)
    parts = {part: write for part in _leaves(spark, folder, len(keys))}
    if only is not None and before is not None:
        kept = {part: at for part, at in before.parts.items() if not _chosen(part, only)}
        both = kept.keys() & parts.keys()
        if both:
            raise ValueError(f"{name}: rows outside the partitions to replace: {sorted(both)[:3]}")
        parts = kept | parts
    fields = [rows.schema[c] for c in rows.columns]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    changed = Table(json.dumps(schema.jsonValue()), keys, form, parts)
    counted = Written(seen.get["rows"], int(seen.get["content"] or 0))
    return tables._replace(tables={**tables.tables, name: changed}), counted


def publish(spark: SparkSession, tables: Snapshot, batch: str | None = None) -> Snapshot:
    """Make the version that follows ``tables.number``; readers see all of it from now on.

    Fails if another writer has published since this one began. A batch name goes
    into the version, so that a batch is not added twice.
    """
    number = tables.number + 1
    if max(version_numbers(spark, tables.root), default=0) >= number:
        raise ValueError(f"{tables.root}: version {number} has come from another writer")
    batches = tables.batches if batch is None else (*tables.batches, batch)
    content = {"tables": {name: t._asdict() for name, t in tables.tables.items()}, "batches": batches}
    draft = f"{tables.root}/{VERSIONS}/.{uuid.uuid4().hex}"
    files, at = _files(spark, draft)
    stream = files.create(at, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    _, to = _files(spark, _version_path(tables.root, number))
    if files.exists(to) or not files.rename(at, to):
        files.delete(at, False)
        raise ValueError(f"{tables.root}: version {number} has come from another writer")
    return tables._replace(number=number, batches=batches)


def forget(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` versions and what only they name.

    Returns the number of write folders removed. Not for use while someone writes, or
    still reads an older version.
    """
    if keep < 1:
        raise ValueError("the newest version stays")
    numbers = version_numbers(spark, root)
    used: dict[str, set[str]] = {}
    for number in numbers[-keep:]:
        for name, found in snapshot(spark, root, number).tables.items():
            used.setdefault(name, set()).update(found.parts.values())
    removed = 0
    for name in _names(spark, root):
        for write in _names(spark, f"{root}/{name}") if name != VERSIONS else []:
            if write.startswith("write=") and write not in used.get(name, ()):
                files, at = _files(spark, f"{root}/{name}/{write}")
                files.delete(at, True)
                removed += 1
    for number in numbers[:-keep]:
        files, at = _files(spark, _version_path(root, number))
        files.delete(at, False)
    return removed
