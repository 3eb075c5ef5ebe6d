"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, made from its code point. A
run of three letters is their vectors, rotated by their place and multiplied sign by
sign (bound). A text is the sum (bundle) of its runs. A language's prototype is the sum
of the unit vectors of its texts, over all rows that may be learned from, in whole
numbers, so that neither order nor partitions matter. A text is predicted to have the
language whose prototype has the largest cosine with it; equal cosines go to the first
language by code points.

Letters are lower-cased; whatever is neither a letter nor a mark (accents, vowel signs)
parts words, and every word is read with a blank on both sides. Null texts and texts
without a letter are ``und`` with score 0, and so is everything when there is nothing
to learn from; a score is the cosine, 0 where that is negative. A null doc_id counts as
the empty text for the held-out fold. Repeated rows are learned from and scored each;
empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.tables import key_text
from timelens.llm.words import mix

DIMENSIONS = 1024
LETTERS = 3
#: Documents whose key has this remainder are never learned from.
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Whole units of one text's vector of length one.
UNIT = 1 << 20
#: Bytes of texts, texts, and runs of letters that are worked on at once.
PIECE, ROWS, RUNS = 1 << 20, 512, 4096

_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For every code point 0, or 1 for a mark and 2 for a letter; made once in a worker."""
    if not _KINDS:
        first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        _KINDS.append(np.array([2 if k == "L" else 1 if k == "M" else 0 for k in first], np.uint8))
    return _KINDS[0]


def letter_signs(codes: np.ndarray) -> np.ndarray:
    """The signs of code points as bits, 64 in a number."""
    words = np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        seeds = mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return mix(seeds[:, None] + words[None, :] * np.uint64(0xD6E8FEB86659FD93))


def run_signs(keys: np.ndarray) -> np.ndarray:
    """Vectors of runs as floats of 1 and -1. Rotating moves a vector by 64 places a letter."""
    bound = np.zeros((len(keys), DIMENSIONS // 64), np.uint64)
    for place in range(LETTERS):
        codes = (keys >> np.uint64(21 * (LETTERS - 1 - place))) & np.uint64((1 << 21) - 1)
        known, at = np.unique(codes, return_inverse=True)
        bound ^= np.roll(letter_signs(known), LETTERS - 1 - place, axis=1)[at]
    bits = np.unpackbits(bound.view(np.uint8), axis=1)
    return 1.0 - 2.0 * bits.astype(np.float32)


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all runs, the text of each run, and which texts have a letter."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owners = np.repeat(np.arange(len(low)), [len(t) for t in low])
    kinds = _kinds()[codes]
    lettered = np.zeros(len(low), bool)
    lettered[owners[kinds == 2]] = True
    codes = np.where(kinds > 0, codes, 0x20).astype(np.uint64)
    blank = kinds == 0
    kept = np.ones(len(codes), bool)
    kept[1:] = ~blank[1:] | ~blank[:-1] | (owners[1:] != owners[:-1])
    codes, owners = codes[kept], owners[kept]
    n = max(len(codes) - LETTERS + 1, 0)
    keys = np.zeros(n, np.uint64)
    for place in range(LETTERS):
        keys = (keys << np.uint64(21)) | codes[place : place + n]
    inside = owners[:n] == owners[LETTERS - 1 :][:n]
    return keys[inside], owners[:n][inside], lettered


def text_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, zero for those without a run, and which have a letter.

    Runs are taken in blocks, so memory depends neither on how many there are nor on
    how many letters a script has.
    """
    keys, owners, lettered = letter_runs(texts)
    known, at = np.unique(keys, return_inverse=True)
    order = np.argsort(at, kind="stable")
    sums = np.zeros((len(texts), DIMENSIONS), np.float64)
    bounds = np.searchsorted(at[order], np.arange(0, len(known) + RUNS, RUNS))
    for block, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        signs = run_signs(known[block * RUNS : (block + 1) * RUNS])
        own = order[lo:hi]
        cells = owners[own] * len(signs) + (at[own] - block * RUNS)
        counts = np.bincount(cells, minlength=len(texts) * len(signs)).reshape(len(texts), -1)
        sums += counts.astype(np.float32) @ signs
    lengths = np.sqrt((sums * sums).sum(axis=1))
    return sums / np.maximum(lengths, 1e-9)[:, None], lettered


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts with the number of the first, by at most ``PIECE`` letters or one text."""
    values = [t or "" for t in texts.to_pylist()]
    lo = size = 0
    for hi, text in enumerate(values):
        if hi > lo and (size + len(text) > PIECE or hi - lo >= ROWS):
            yield lo, values[lo:hi]
            lo, size = hi, 0
        size += len(text)
    if values:
        yield lo, values[lo:]


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's texts for every language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lo, texts in _blocks(batch.column("text")):
            vectors, lettered = text_vectors(texts)
            whole = np.rint(vectors * UNIT).astype(np.int64)
            own = langs[lo : lo + len(texts)]
            for lang in set(own[lettered]):
                of = lettered & (own == lang)
                sums[lang] = sums.get(lang, 0) + whole[of].sum(axis=0)
    names = list(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([sums[n] for n in names], pa.list_(pa.int64()))], names=["lang", "bundle"]
    )


def is_held_out(key: Column) -> Column:
    """crc32 of the key as text has the remainder that is never learned from."""
    return F.crc32(key_text(key)) % FOLDS == HELD_OUT


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """A unit vector for every language, learned from all rows that are not held out.

    The driver and every task hold one vector a language, 8 KB each: languages are
    the distinct values of ``lang``, which are some thousands in the whole world.
    """
    rows = docs.filter(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id"))).select("lang", "text")
    sums = rows.mapInArrow(_bundle, "lang string, bundle array<bigint>")
    cells = sums.select("lang", F.posexplode("bundle").alias("place", "value"))
    added = cells.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    whole = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells"))
    found = {}
    for row in whole.select("lang", "cells.value").collect():
        vector = np.array(row.value, float)
        found[row.lang] = vector / max(np.sqrt(vector @ vector), 1e-9)
    return dict(sorted(found.items()))


def predictor(learned: dict[str, np.ndarray]):
    """A function of a text column that gives its language and score."""
    names = list(learned)
    table = np.array([learned[n] for n in names]).reshape(len(names), DIMENSIONS)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for _, own in _blocks(texts):
            vectors, lettered = text_vectors(own)
            if not names:
                lettered[:] = False
                cosines = np.zeros((len(own), 1))
            else:
                cosines = np.clip(vectors @ table.T, 0.0, 1.0)
            best = cosines.argmax(axis=1)
            langs += [names[b] if known else UNKNOWN for b, known in zip(best, lettered)]
            scores.append(np.where(lettered, cosines[np.arange(len(own)), best], 0.0))
        score = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], ["lang", "score"])

    return predict


def judge_language(docs: DataFrame) -> DataFrame:
    """``lang_pred``, ``score`` and fold of every document. Learns when called."""
    predict = predictor(prototypes(docs))
    found = docs.select("doc_id", predict(F.col("text")).alias("found"))
    return found.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score"
    )
