"""Quality classifier: logistic regression on hashed word n-grams.

Words (runs of letters and digits) and signs (runs of other characters) and their
pairs are hashed into ``BUCKETS`` weights; a text's value for one is its share of all
n-grams of the text. All pairs of a word with itself are one n-gram, and whether a word
comes again after the next one is another, so that repetition is seen whatever the
word. The weights are trained with follow-the-regularised-leader
updates on a bounded sample of labelled documents, in ``SHARDS`` shards whose weights
are averaged. A score is a sparse dot product of the whole text.

Empty tables give empty results; without labelled documents all scores are 0.5. Null
and empty texts have no n-gram and get the score of the bias alone. Repeated rows are
scored alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.labels import is_held_out, labelled_documents, training_sample
from timelens.llm.words import LETTERS_AND_SIGNS, Piece, gram_hashes, mix, pieces, split

BUCKETS_LOG2 = 18
BUCKETS = 1 << BUCKETS_LOG2
#: Labelled documents of each label that are trained on, at most.
MOST_PER_CLASS = 4000
SHARDS, EPOCHS = 4, 4
#: Step size, its offset and the penalties of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.01, 0.05
#: Shares are scaled up so that weights stay of the order of one.
SCALE = 10.0
#: Scores from this one on are predicted to be good.
GOOD = 0.3

#: Stand-ins for a word and itself, for a word that comes again after the next, and for others.
_SAME, _AGAIN, _OTHER = mix(np.arange(1, 4, dtype=np.uint64))


def buckets(piece: Piece) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For words, pairs and skips: the buckets, and each text's range of them."""
    words = split(piece.data, piece.offsets, LETTERS_AND_SIGNS, fold=False)
    pairs, at, first = gram_hashes(words, 2)
    pairs[words.hashes[at] == words.hashes[at + 1]] = _SAME
    _, at, skip_first = gram_hashes(words, 3)
    skips = np.where(words.hashes[at] == words.hashes[at + 2], _AGAIN, _OTHER)
    shift = np.uint64(64 - BUCKETS_LOG2)
    found = [(h >> shift).astype(np.int64) for h in (words.hashes, pairs, skips)]
    return found, [words.first, first, skip_first]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as sparse rows."""
    for batch in batches:
        for piece in pieces(batch.column("text")):
            found, ranges = buckets(piece)
            index, value = [], []
            for i in range(piece.hi - piece.lo):
                own = np.concatenate([b[r[i] : r[i + 1]] for b, r in zip(found, ranges)])
                at, times = np.unique(own, return_counts=True)
                index.append(at.astype(np.int32))
                value.append((times * (SCALE / max(len(own), 1))).astype(np.float32))
            rows = slice(piece.lo, piece.hi)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("shard").slice(rows.start, rows.stop - rows.start),
                    batch.column("turn").slice(rows.start, rows.stop - rows.start),
                    batch.column("label").slice(rows.start, rows.stop - rows.start),
                    pa.array(index, pa.list_(pa.int32())),
                    pa.array(value, pa.list_(pa.float32())),
                ],
                names=["shard", "turn", "label", "index", "value"],
            )


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over (buckets, values, label); the last is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        lead = z[at]
        shrunk = np.sign(lead) * np.maximum(np.abs(lead) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for index, value, label in rows:
            at, x = np.append(index, BUCKETS), np.append(value, 1.0)
            w = weights(at)
            gradient = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35.0, 35.0))) - label) * x
            squared = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squared
    return weights(np.arange(BUCKETS + 1))


def _train_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("turn", kind="stable")
    examples = list(zip(rows["index"], rows["value"], rows["label"].astype(float)))
    weights = follow_the_leader(examples).astype(np.float32)
    return pd.DataFrame({"weights": [weights.tobytes()]})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_per_class: int = MOST_PER_CLASS) -> np.ndarray:
    """The averaged weights of all shards.

    A shard is trained in one task on its part of the bounded sample; the driver gets
    ``SHARDS`` weight vectors.
    """
    sample = training_sample(labels, label, most_per_class)
    turn = F.xxhash64("doc_id", "text")
    rows = labelled_documents(docs, sample).select(
        "text", "label", turn.alias("turn"), F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS)).alias("shard")
    )
    examples = rows.mapInArrow(
        _examples, "shard long, turn long, label int, index array<int>, value array<float>"
    )
    trained = examples.groupBy("shard").applyInPandas(_train_shard, "weights binary").collect()
    if not trained:
        return np.zeros(BUCKETS + 1)
    return np.mean([np.frombuffer(bytes(r.weights), np.float32) for r in trained], axis=0)


def scorer(weights: np.ndarray):
    """A function of a text column that gives its score."""
    table, bias = weights[:-1].astype(np.float64), float(weights[-1])

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        scores = []
        for piece in pieces(texts):
            total, count = np.zeros(piece.hi - piece.lo), np.zeros(piece.hi - piece.lo)
            for found, ranges in zip(*buckets(piece)):
                sums = np.concatenate([[0.0], np.cumsum(table[found])])
                total += sums[ranges[1:]] - sums[ranges[:-1]]
                count += np.diff(ranges)
            raw = bias + SCALE * total / np.maximum(count, 1)
            scores.append(1.0 / (1.0 + np.exp(-np.clip(raw, -35.0, 35.0))))
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return score


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, prediction and fold of every document. Trains when called."""
    score = scorer(train(docs, labels))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted to be good, all columns kept. Trains when called."""
    score = scorer(train(docs, labels))
    return docs.filter(score(F.col("text")) >= GOOD)
