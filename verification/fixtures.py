"""The given tables seen as time entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.operators.entries import clean_entries, tag_entries

PROJECTS = (
    "CS 461 Capstone",
    "Exercise",
    "Get Hired at Dream Job",
    "Class",
    "Hacker Refactor",
    "Smart Compost Internship",
    "Scuba",
    "",
    "Dog Training",
    "Gardening",
    "Teaching Assistant Job",
)

DESCRIPTIONS = (
    "Homwork",
    "Exercise",
    "Prepare for SACNAS",
    "Search for housing",
    "Meetings",
    "Apply",
    "Research",
    "Resume",
    "Email advisor",
    "Walk the dog",
    "Ford Scholarship",
    "Thank you letter",
    "Misc",
)

YEARS = tuple(str(y) for y in range(1995, 2002))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        # A session for tests without a shared folder: the warehouse is one.
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uncleaned time entries."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    minutes = customer * 7 % 300
    projects = F.array(*[F.lit(p) for p in PROJECTS])
    descriptions = F.array(*[F.lit(d) for d in DESCRIPTIONS])
    start = F.timestamp_add("MINUTE", (key * 37 % 1440).cast("int"), F.col("o_orderdate").cast("timestamp"))
    return (
        _table(spark, sf_dir, "orders")
        .select(
            key.alias("entry_id"),
            F.get(projects, (key % 11).cast("int")).alias("project"),
            F.get(descriptions, (key % 13).cast("int")).alias("description"),
            F.when(key % 3 == 0, "No").otherwise("Yes").alias("billable"),
            start.alias("start"),
            (minutes * 60).alias("duration"),
            minutes.cast("int").alias("minutes"),
        )
        .withColumn("end", F.timestamp_add("MINUTE", F.col("minutes"), F.col("start")))
        .drop("minutes")
    )


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clean, tagged time entries."""
    return tag_entries(clean_entries(order_rows(spark, sf_dir)))


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as time entries: one dense month, sub-minute starts."""
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    seconds = F.round(F.col("value") * 60).cast("bigint")
    return (
        _table(spark, sf_dir, "events")
        .select(
            F.col("event_id").alias("entry_id"),
            F.col("event_type").alias("project"),
            F.concat(F.lit("user "), (F.col("user_id") % 10).cast("string")).alias("description"),
            F.array("event_type").alias("type"),
            start.alias("start"),
            seconds.alias("duration"),
        )
        .withColumn("end", F.timestamp_add("SECOND", F.col("duration").cast("int"), F.col("start")))
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows to tag: the source is the project, the whole text the description."""
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("project"), F.col("text").alias("description")
    )
