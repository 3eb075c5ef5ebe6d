"""The two classifiers: held-out accuracy on the given labels, and awkward rows."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from timelens.llm import quality, toxicity
from timelens.llm.tables import read_table

SF_DIR = "/root/testdata/sf0.1"
DOCUMENTS = "doc_id long, text string"

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def labelled(spark, judged, label):
    return judged(read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "labels")).join(
        read_table(spark, SF_DIR, "labels").select("doc_id", F.col(label).alias("truth")), "doc_id"
    )


@needs_tables
@pytest.mark.parametrize("judge, label, least", [(quality.judge_quality, "quality", 0.97), (toxicity.judge_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, judge, label, least):
    rows = labelled(spark, judge, label).filter("held_out").select("truth", "predicted").collect()
    right = sum(r.truth == r.predicted for r in rows)
    assert len(rows) > 300 and right / len(rows) >= least
    majority = max(sum(r.truth for r in rows), sum(1 - r.truth for r in rows)) / len(rows)
    assert right / len(rows) > majority


def made(spark, good, bad):
    texts = [(k, good(k)) for k in range(200)] + [(1000 + k, bad(k)) for k in range(200)]
    odd = [(None, None), (5000, ""), (5001, " \n "), (5002, "x"), (7, good(7)), (5003, good(1) * 2000)]
    docs = spark.createDataFrame(texts + odd, DOCUMENTS).withColumns(
        {c: F.lit("clash") for c in ("score", "label", "of", "shard", "turn")}
    )
    labels = spark.createDataFrame(
        [(d, int(d < 1000), int(d >= 1000)) for d, _ in texts] + [(3, 1, 0), (4, None, None), (None, 1, 0), (99999, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    return docs, labels, len(texts) + len(odd)


@pytest.mark.parametrize("judge", [quality.judge_quality, toxicity.judge_toxicity])
def test_awkward_rows(spark, judge):
    good = lambda k: f"plain words number{k} of a text that reads well{k % 7} and goes on"
    bad = lambda k: f"some words ### you dumbhead{'sy' * (k % 3)} and more ### of it{k}"
    docs, labels, n = made(spark, good, bad)
    rows = judge(docs, labels).collect()
    assert len(rows) == n
    for r in rows:
        assert 0.0 <= r.score <= 1.0
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    low = {r.doc_id for r in rows if r.predicted == 0 and r.doc_id is not None and r.doc_id < 2000}
    wanted = range(1000, 1200) if judge is quality.judge_quality else range(200)
    assert len(low ^ set(wanted)) <= 8
    assert judge(docs.limit(0), labels).count() == 0
    alone = judge(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in alone] == [0.5 if judge is quality.judge_quality else 0.0]


def test_disguised_insults(spark):
    good = lambda k: f"quiet talk of house{k % 50} and river{k % 31} by the long road{k % 17}"
    words = ("dumbhead", "filthbag", "scumling")
    bad = lambda k: f"quiet talk you {words[k % 3]} by the road{k % 17}"
    docs, labels, _ = made(spark, good, bad)
    asked = [(1, "talk of d.u.m.b.h.e.a.d here"), (2, "a f i l t h b a g by the house"), (3, "you scum-ling!"), (4, "talk of dumbxhead"), (5, "by the river road house")]
    machine = toxicity.train(docs, labels)
    score = toxicity.scorer(machine)
    found = spark.createDataFrame(asked, DOCUMENTS).select("doc_id", score(F.col("text")).alias("score"))
    assert {r.doc_id for r in found.collect() if r.score >= 0.5} == {1, 2, 3, 4}


def test_good_documents_keep_all_columns(spark):
    good = lambda k: f"plain words number{k} of a text that reads well"
    docs, labels, _ = made(spark, good, lambda k: f"### {k} ### $$$ %%%")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(200)) <= ids and not any(1000 <= (d or 0) < 1200 for d in ids)
