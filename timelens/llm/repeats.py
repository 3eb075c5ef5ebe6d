"""Removal of repeated passages by recompression.

The words of a text are names. A first step names runs of equal words; each of
``ROUNDS`` more gives every name a side, left or right, and names each pair of a left
one and a right one after it. A name is a hash of what it stands for, so all tasks
agree on it without a common dictionary, and equal passages get equal names except
near their ends: whether two names are joined depends on these two and their next
neighbours only. For every name the words are kept track of that it depends on; it
is certain for all windows that hold these words, whatever stands around them.

A window of ``WINDOW`` words can occur twice only if all names that are certain for it
do. Spark finds the names that occur twice, and the texts with such names come back;
their windows whose certain names are all shared are hashed, and Spark finds the
hashes that occur twice. Windows without a certain name stand for themselves in the
first round.

Equal texts are one text in both rounds; all their windows are repeated.

Empty tables give empty results. Null, empty and blank texts have no words and lose
none; so do texts of fewer words than a window. Rows are judged by their texts:
repeated rows are copies of each other. Other columns are ignored. Texts, names and
windows are equal when their 64-bit hashes are; texts are told apart by two, and the
job fails if one agrees and the other does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.tables import settle
from timelens.llm.words import BLANK_SEPARATED, Words, gram_hashes, mix, pieces, split

WINDOW = 35
#: With six rounds nearly every window of 35 words has a certain name.
ROUNDS = 6


class Names(NamedTuple):
    """Names of a piece with the first and last word that each depends on."""

    name: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _shifted(values: np.ndarray, by: int) -> np.ndarray:
    """Each place gets the value ``by`` places later; none comes from beyond the ends."""
    out = np.zeros_like(values)
    if by > 0:
        out[:-by] = values[by:]
    else:
        out[-by:] = values[:by]
    return out


def recompress(words: Words, rounds: int = ROUNDS) -> Names:
    """Names after the last round that are certain for some window.

    What a name depends on may lie beyond its text's ends; no window holds that.
    """
    owner, name = words.owners(), words.hashes
    n = len(name)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Names(name, none, none)
    # Runs: each depends on the words next to it, from which it differs.
    again = np.zeros(n, bool)
    again[1:] = (name[1:] == name[:-1]) & (owner[1:] == owner[:-1])
    start = np.flatnonzero(~again)
    length = np.diff(np.append(start, n))
    with np.errstate(over="ignore"):
        run = mix(name[start] * np.uint64(3) + length.astype(np.uint64))
    name, owner = np.where(length > 1, run, name[start]), owner[start]
    begin, end = start, start + length - 1
    first, last = begin - 1, end + 1

    for k in range(rounds):
        left = (mix(name + np.uint64(0x9E37 * (k + 1))) >> np.uint64(17)) & np.uint64(1) == 0
        inner = np.zeros(len(name), bool)
        inner[:-1] = owner[1:] == owner[:-1]
        follows = np.zeros(len(name), bool)
        follows[1:] = inner[:-1]
        # A left name looks at the next one, a right one at the one before.
        beside_first = np.where(
            left, np.where(inner, _shifted(first, 1), first), np.where(follows, _shifted(first, -1), begin - 1)
        )
        beside_last = np.where(
            left, np.where(inner, _shifted(last, 1), end + 1), np.where(follows, _shifted(last, -1), last)
        )
        first, last = np.minimum(first, beside_first), np.maximum(last, beside_last)
        pair = left & inner & ~_shifted(left, 1)
        with np.errstate(over="ignore"):
            joined = mix(name * np.uint64(5) + mix(_shifted(name, 1) + np.uint64(k)))
        name, end = np.where(pair, joined, name), np.where(pair, _shifted(end, 1), end)
        kept = np.ones(len(name), bool)
        kept[1:] = ~pair[:-1]
        name, owner, begin, end = name[kept], owner[kept], begin[kept], end[kept]
        first, last = first[kept], last[kept]
    certain = (
        (first >= words.first[owner]) & (last < words.first[owner + 1]) & (last - first < WINDOW)
    )
    return Names(name[certain], first[certain], last[certain])


class Windows(NamedTuple):
    """All windows of a piece: hash, first word, text; and the names certain for them."""

    hashes: np.ndarray
    at: np.ndarray
    first: np.ndarray
    names: Names

    def without_name(self, n_words: int) -> np.ndarray:
        return self._holding(self.names, n_words) == 0

    def _holding(self, names: Names, n_words: int) -> np.ndarray:
        """How many of the names are certain for each window."""
        change = np.zeros(n_words + 1, np.int64)
        np.add.at(change, np.maximum(names.last - WINDOW + 1, 0), 1)
        np.add.at(change, names.first + 1, -1)
        return np.cumsum(change)[self.at]

    def unshared(self, shared: np.ndarray, n_words: int) -> np.ndarray:
        """Windows that hold a certain name that is not shared."""
        other = ~np.isin(self.names.name, shared)
        return self._holding(Names(*[v[other] for v in self.names]), n_words) > 0


def _windows(words: Words) -> Windows:
    hashes, at, first = gram_hashes(words, WINDOW)
    return Windows(hashes, at, first, recompress(words))


def _own_name(hashes: np.ndarray) -> np.ndarray:
    """The name of a window that stands for itself."""
    return mix(hashes + np.uint64(0x35))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


def _names_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, fp, times) for every text that the task has not met before."""
    seen: set[int] = set()
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for piece in pieces(batch.column("text")):
            words = split(piece.data, piece.offsets, BLANK_SEPARATED, fold=False)
            found = _windows(words)
            own = found.without_name(len(words.hashes))
            owner = words.owners()
            name = np.concatenate([found.names.name, _own_name(found.hashes[own])])
            text = np.concatenate([owner[found.names.first], owner[found.at[own]]])
            ids = fps[piece.lo : piece.hi]
            new = np.array([not (f in seen or seen.add(f)) for f in ids.tolist()], bool)
            name, text = name[new[text]], text[new[text]]
            order = np.lexsort((name, text))
            name, text = name[order], text[order]
            start = np.flatnonzero(
                np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])[: len(name)]
            )
            times = np.diff(np.append(start, len(name)))
            yield pa.RecordBatch.from_arrays(
                [_signed(name[start]), pa.array(ids[text[start]]), pa.array(times.astype(np.int32))],
                names=["name", "fp", "times"],
            )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, fp, start) of every window whose certain names are all shared.

    Rows that repeat a document have one text, and a task takes the first of them.
    """
    seen: set[int] = set()
    for batch in batches:
        new = {fp: i for i, fp in reversed(list(enumerate(batch.column("fp").to_pylist()))) if fp not in seen}
        seen.update(new)
        batch = batch.take(pa.array(sorted(new.values()), pa.int64()))
        fps, shared = batch.column("fp").to_numpy(), batch.column("names")
        for piece in pieces(batch.column("text")):
            known = shared.slice(piece.lo, piece.hi - piece.lo).flatten().to_numpy().view(np.uint64)
            known = np.unique(known)
            words = split(piece.data, piece.offsets, BLANK_SEPARATED, fold=False)
            found = _windows(words)
            n = len(words.hashes)
            keep = ~found.unshared(known, n)
            alone = found.without_name(n)
            keep[alone] = np.isin(_own_name(found.hashes[alone]), known)
            owner = words.owners()[found.at[keep]] if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(found.hashes[keep]),
                    pa.array(fps[piece.lo : piece.hi][owner]),
                    pa.array((found.at[keep] - words.first[owner]).astype(np.int32)),
                ],
                names=["hash", "fp", "start"],
            )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that no repeated window covers, joined by blanks."""
    for batch in batches:
        copied, starts = batch.column("copied").to_pylist(), batch.column("starts")
        counts, removed, kept = [], [], []
        for i, text in enumerate(batch.column("text")):
            words = (text.as_py() or "").encode().split()
            n = len(words)
            here = starts[i].values
            gone = 0
            if copied[i] and n >= WINDOW:
                words, gone = [], n
            elif here is not None and len(here):
                change = np.zeros(n + 1, np.int64)
                at = here.to_numpy()
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
                stays = np.cumsum(change)[:-1] == 0
                words = list(compress(words, stays.tolist()))
                gone = n - len(words)
            counts.append(n)
            removed.append(gone)
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("fp"), text.alias("text"))


def repeated_windows(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``fp`` and ``starts``: first words of the windows that occur elsewhere too.

    One row for each different text that has such windows besides whole copies.
    """
    rows = _hashed(docs)
    names = settle(
        rows.select("fp", "text").mapInArrow(_names_of_texts, "name long, fp long, times int"), "names"
    )
    # Copies of a text in several tasks are no second occurrence.
    several = (F.min("fp") != F.max("fp")) | (F.max("times") > 1)
    shared = settle(names.groupBy("name").agg(several.alias("shared")).filter("shared").select("name"), "shared")
    chosen = (
        names.join(shared, "name")
        .groupBy("fp")
        .agg(F.collect_set("name").alias("names"))
        .join(classes, "fp")
        .select("fp", "doc_id", "names")
    )
    chosen = settle(chosen, "chosen").alias("c")
    same = (F.col("d.fp") == F.col("c.fp")) & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))
    texts = rows.alias("d").join(chosen, same).select("d.fp", "c.names", "d.text")
    windows = texts.mapInArrow(_candidates, "hash long, fp long, start int")
    # Of rows that repeat a document each task still has one.
    windows = settle(windows.repartition("hash").distinct(), "windows")
    twice = settle(
        windows.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("hash"), "twice"
    )
    return windows.join(twice, "hash").groupBy("fp").agg(F.collect_list("start").alias("starts"))


def text_classes(docs: DataFrame) -> DataFrame:
    """Different texts: ``fp``, a ``doc_id`` that has it, and whether it has copies."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("fp"), F.xxhash64(F.lit("again"), text).alias("again")
    )
    copied = F.when(F.min("again") == F.max("again"), F.count(F.lit(1)) > 1).otherwise(
        F.raise_error(F.lit("two texts have one hash")).cast("boolean")
    )
    return rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), copied.alias("copied"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and the ``kept`` words of every document.

    Writes intermediate tables when called.
    """
    classes = settle(text_classes(docs), "classes")
    starts = repeated_windows(docs, classes)
    verdicts = classes.join(starts, "fp", "left").select(F.col("fp").alias("of"), "copied", "starts")
    verdicts = settle(verdicts.filter("copied or starts is not null"), "verdicts")
    rows = (
        _hashed(docs)
        .join(verdicts, F.col("fp") == F.col("of"), "left")
        .select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "starts")
    )
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    return rows.mapInArrow(_remove, schema)
