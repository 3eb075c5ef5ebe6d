"""Tables that change in one step: readers, failed writes, partitions, clustering."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from timelens.session import new_work_dir
from timelens.sources import snapshots
from timelens.sources.snapshots import forget, found_rows, publish, replace, snapshot, table, version_numbers
from timelens.sources.tables import read_table, write_table


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The tables of these tests are tiny, and growing rollups run many jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_a_reader_goes_on_with_what_it_opened(spark):
    out = new_work_dir(spark, "table")
    write_table(spark.range(100), out)
    opened = read_table(spark, out)
    write_table(spark.range(5).withColumn("more", F.lit("x")), out)
    assert opened.count() == 100 and read_table(spark, out).count() == 5
    assert read_table(spark, out).columns == ["id", "more"]
    assert version_numbers(spark, out) == [1, 2]
    assert rows_of(table(spark, snapshot(spark, out, 1), "rows")) == [(i,) for i in range(100)]


def test_a_failed_write_changes_nothing(spark):
    out = new_work_dir(spark, "table")
    write_table(spark.range(100), out)
    bad = spark.range(50).withColumn("v", F.when(F.col("id") < 40, 1).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises((PySparkException, Py4JJavaError)):
        write_table(bad, out)
    assert read_table(spark, out).columns == ["id"] and read_table(spark, out).count() == 100
    assert version_numbers(spark, out) == [1]


def test_files_that_fail_the_check_are_not_published(spark, monkeypatch):
    out = new_work_dir(spark, "table")
    write_table(spark.range(100), out)
    monkeypatch.setattr("timelens.sources.tables.found_rows", lambda rows: snapshots.Written(1, 1))
    with pytest.raises(ValueError, match="wrote"):
        write_table(spark.range(7), out, check=True)
    assert read_table(spark, out).count() == 100


def test_only_one_of_two_writers_publishes(spark):
    out = new_work_dir(spark, "tables")
    start = snapshot(spark, out)
    mine, _ = replace(start, "a", spark.range(3))
    other, _ = replace(start, "a", spark.range(4))
    publish(spark, other)
    with pytest.raises(ValueError, match="another writer"):
        publish(spark, mine)
    assert table(spark, snapshot(spark, out), "a").count() == 4


def test_partitions_that_stay_keep_their_files(spark):
    out = new_work_dir(spark, "tables")
    made = spark.createDataFrame([("a", None, 1), ("a", "1999", 2), ("b", "1999", 3), ("b", "2000", 4)], "k string, y string, v int")
    first, _ = replace(snapshot(spark, out), "t", made, ["k", "y"])
    first = publish(spark, first)
    new = spark.createDataFrame([("a", "1999", 20), ("b", "1999", 30), ("c", "1999", 40)], "k string, y string, v int")
    second, written = replace(first, "t", new, ["k", "y"], only={"y": ["1999"]})
    assert written.rows == 3 and found_rows(table(spark, second, "t", {"y": ["1999"]})) == written
    second = publish(spark, second)
    wanted = [("a", "1999", 20), ("b", "1999", 30), ("b", "2000", 4), ("c", "1999", 40)]
    assert sorted(r for r in rows_of(table(spark, second, "t").filter("y IS NOT NULL"))) == wanted
    assert rows_of(table(spark, second, "t", {"y": [None]})) == [("a", None, 1)]
    kept = {p for p, w in second.tables["t"].parts.items() if first.tables["t"].parts.get(p) == w}
    assert kept == {"k=a/y=__HIVE_DEFAULT_PARTITION__", "k=b/y=2000"}
    with pytest.raises(ValueError, match="outside"):
        replace(second, "t", made, ["k", "y"], only={"y": ["1999"]})
    with pytest.raises(ValueError, match="stored by"):
        replace(second, "t", made, ["k"], only={"y": ["1999"]})
    assert table(spark, second, "t", {"k": ["no such"]}).collect() == []
    # The partition 1999 goes when nothing is left in it.
    third, _ = replace(second, "t", new.limit(0), ["k", "y"], only={"y": ["1999"]})
    assert rows_of(table(spark, third, "t").filter("y = '1999'")) == []


def test_clustering_samples_nothing_to_the_driver(spark, monkeypatch):
    """Ranges would need bounds, which are sampled: so many keys for every partition."""
    def ranges(*_):
        raise AssertionError("rows are sampled to the driver")

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", ranges)
    months = F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0")
    made = spark.range(0, 6000, 1, 4).select(
        F.lit("s").alias("k"), months.alias("m"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    hot = made.unionByName(made.withColumn("m", F.lit("04")))
    sizes = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {name: spark.conf.get(name) for name in sizes}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        out = new_work_dir(spark, "tables")
        tables, written = replace(snapshot(spark, out), "t", hot, ["k"], ["m", "v"])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    stored = table(spark, tables, "t")
    assert found_rows(stored) == written == found_rows(hot)
    of_file = {}
    for row in stored.select(F.input_file_name().alias("f"), "m", "v").collect():
        of_file.setdefault(row.f, []).append((row.m, row.v))
    assert all(rows == sorted(rows) for rows in of_file.values())
    files_of = {m: {f for f, rows in of_file.items() if any(r[0] == m for r in rows)} for m in ("01", "04")}
    assert len(files_of["04"]) > 1 == len(files_of["01"])  # a large month spans tasks, a small one does not


def test_forgotten_versions_leave_the_newest_alone(spark):
    out = new_work_dir(spark, "table")
    for n in (1, 2, 3):
        write_table(spark.range(n), out)
    assert forget(spark, out) == 2 and version_numbers(spark, out) == [3]
    assert read_table(spark, out).count() == 3
    with pytest.raises(ValueError):
        forget(spark, out, 0)


def test_empty_tables_have_their_columns(spark):
    out = new_work_dir(spark, "table")
    write_table(spark.range(0).withColumn("k", F.lit("x")), out, ["k"])
    assert read_table(spark, out).columns == ["id", "k"] and read_table(spark, out).count() == 0


def test_other_forms(spark):
    out = new_work_dir(spark, "tables")
    made = spark.createDataFrame([("s1", '{"a":1}'), ("s2", "[]")], "section string, json string")
    tables, _ = replace(snapshot(spark, out), "d", made, ["section"], form="json")
    assert rows_of(table(spark, publish(spark, tables), "d")) == rows_of(made)
