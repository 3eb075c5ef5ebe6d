"""Rows, texts and sentences that a third of the input shares."""

import random

from pyspark.sql import functions as F

from timelens.llm import decontaminate, mixing, repeats, sharding
from timelens.llm.tables import CHUNK

SCHEMA = "doc_id long, text string, source string"


def hot_table(spark, hot, others):
    same = spark.range(hot).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one and the same row").alias("text"), F.lit("s").alias("source"))
    rest = spark.range(others).select(
        (F.col("id") + 100).alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source")
    )
    return same.unionByName(rest)


def tasks_of(rows, condition):
    return rows.withColumn("task", F.spark_partition_id()).filter(condition).select("task").distinct().count()


def test_copies_of_a_row_are_sharded_by_several_tasks(spark):
    docs = hot_table(spark, 33_000, 66_000)
    placed = sharding.shard_documents(docs)
    assert tasks_of(placed, "doc_id = 7") > 1
    slots = placed.groupBy("shard").agg(
        F.count("slot").alias("n"), F.count_distinct("slot").alias("different"), F.min("slot").alias("least"), F.max("slot").alias("most")
    )
    for row in slots.collect():
        assert row.n == row.different == row.most + 1 and row.least == 0
    assert placed.count() == 99_000 and placed.filter("doc_id = 7").select("shard").distinct().count() == 1


def test_copies_of_a_row_are_mixed_by_several_tasks(spark):
    docs = hot_table(spark, 33_000, 66_000)
    placed = mixing.place_documents(docs)
    assert placed.count() == 99_000 and tasks_of(placed, "doc_id = 7") > 1
    taken = placed.select(F.sum(F.col("size") * F.size("positions")).alias("taken"), F.max("target").alias("target")).first()
    assert abs(taken.taken / taken.target - 1) < 0.001


def test_few_copies_are_numbered_like_many(spark):
    """Around the size of a chunk no copy is lost or made twice."""
    rows = [(k, "a b c", "s") for k, n in enumerate((1, 2, CHUNK - 1, CHUNK, CHUNK + 1, 2 * CHUNK + 3)) for _ in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sharding.shard_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {k: sum(r[0] == k for r in rows) for k in range(6)}


def test_rows_of_one_document_are_one_text(spark):
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(999)}" for _ in range(104))
    rows = [(1, passage, "s")] * 300 + [(2, f"start {passage} end", "s"), (3, "nothing of it", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    starts = {r.fp: r.starts for r in repeats.repeated_windows(docs, repeats.text_classes(docs)).collect()}
    assert sorted(len(s) for s in starts.values()) == [70, 70]
    assert all(len(s) == len(set(s)) for s in starts.values())
    removed = {(r.doc_id, r.n_words, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
    assert removed == {(1, 104, 104), (2, 106, 104), (3, 3, 0)}


def joined_rows(frame):
    """The most rows that a join of the plan put out."""
    frame._jdf.collectToPython()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        own = int(node.metrics().apply("numOutputRows").value()) if "Join" in name else 0
        children = node.children()
        return max([own, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(frame._jdf.queryExecution().executedPlan())


def test_a_sentence_of_all_documents_and_items_is_no_hit(spark):
    """A common sentence shorter than a window costs rows in proportion, and finds nothing."""
    sentence = "this common sentence stands in all of them"
    most = {}
    for n in (50, 200):
        text = lambda kind, k: " ".join([*(f"{kind}{k}x{i}" for i in range(20)), sentence, *(f"{kind}{k}y{i}" for i in range(20))])
        docs = spark.createDataFrame([(k, text("d", k), "s") for k in range(n)], SCHEMA)
        items = spark.createDataFrame([(k, text("b", k)) for k in range(n)], "item_id long, text string")
        spans = decontaminate.hit_spans(docs, decontaminate.fingerprints(docs), items)
        most[n] = joined_rows(spans)
        assert spans.count() == 0
    assert most[200] <= 6 * max(most[50], 200)
