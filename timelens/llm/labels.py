"""Labelled documents for training, split the same way for every classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.llm.tables import key_text

#: Documents whose key has this remainder are held out; one in ``FOLDS``.
FOLDS = 5


def is_held_out(key: Column) -> Column:
    """crc32 of the key as text is divisible by ``FOLDS``; a null key counts as empty text."""
    return F.crc32(key_text(key)) % FOLDS == 0


def training_sample(labels: DataFrame, label: str, most_per_class: int) -> DataFrame:
    """``of`` (a doc_id) and ``label`` of at most ``most_per_class`` documents of each label.

    Held-out documents never appear. Null labels are ignored, and a document that is
    labelled more than once has the more frequent label, 1 if there are as many. Which
    documents are taken depends on a hash of their keys only.
    """
    known = labels.filter(F.col(label).isNotNull() & ~is_held_out(F.col("doc_id")))
    voted = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    ordered = voted.select(F.col("doc_id").alias("of"), "label").orderBy(
        F.xxhash64(key_text(F.col("of")), F.lit("training")), "of"
    )
    positive = ordered.filter("label = 1").limit(most_per_class)
    return positive.unionByName(ordered.filter("label = 0").limit(most_per_class))


def labelled_documents(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Texts of the sample with their labels.

    The sample is sent to all tasks: it has a row for each of a bounded number of
    documents, so no text is shuffled.
    """
    chosen = F.broadcast(sample)
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "text", "label")
