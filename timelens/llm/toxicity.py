"""Toxicity: a support vector machine on a subsequence string kernel.

The kernel compares two short strings (units) by the three-letter subsequences they
share, gaps allowed: each occurrence counts ``DECAY`` for every place that it skips,
and spans ``SPAN`` places at most, so an insult keeps most of its subsequences when
letters or signs are put in between or an ending changes. Signs are places, but no
letters; the ends of a unit count as letters. Units are words between blanks, runs
of single letters being one unit; a document is as toxic as its worst unit.

Landmarks are units of the training documents. In the space that they span (Nyström)
a linear machine with squared hinge loss is trained on units: those found in several
toxic documents and in no other one, also with a letter put in, against units of
other documents, and then again with the worst units of those as more examples and
landmarks. As the kernel is a product of subsequence counts, landmarks and machine
fold into one weight for every subsequence.

Empty tables give empty results; without labelled documents of both kinds all scores
are 0. Null and empty texts and texts of units below three letters get the lowest
margin, that of a unit which shares nothing with any landmark. Repeated rows are
scored alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.labels import is_held_out, labelled_documents, training_sample
from timelens.llm.tables import BLANKS, lower_ascii, settle
from timelens.llm.words import BLANK_SEPARATED, Piece, pieces, split

SPAN, DECAY = 5, 0.5
#: Labelled documents of each label that are trained on, at most.
MOST_PER_CLASS = 3000
#: Units trained on: found in toxic documents, frequent elsewhere, any elsewhere.
MOST_TOXIC, MOST_FREQUENT, MOST_OTHER = 600, 400, 2000
LONGEST_UNIT = 60
#: Landmarks among toxic units, other units and the worst units of other documents.
TOXIC_LANDMARKS, OTHER_LANDMARKS, HARD_LANDMARKS = 200, 50, 250
#: Expected number of harmless units among the toxic ones.
CHANCE_UNITS = 0.5
COST = 10.0
HARD_ROUNDS = 3
TOXIC = 0.5

_PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _code(b: int) -> int:
    """Letters without case, digits, and classes of other bytes; 0 for blanks and signs."""
    if 0x41 <= b <= 0x5A:
        return b - 0x40
    if 0x61 <= b <= 0x7A:
        return b - 0x60
    if 0x30 <= b <= 0x39:
        return b - 0x30 + 27
    return 37 + b % 26 if b >= 0x80 else 0


#: What stands before and after a unit.
EDGE = 63
CODES = np.array([_code(b) for b in range(256)], np.int32)


class Units(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def units(piece: Piece) -> tuple[np.ndarray, Units]:
    """The bytes with a blank before each text and at the end, and the units in them.

    A unit's range goes from the blank before it to the blank after it, both included.
    ``first`` has each text's range of units.
    """
    data = np.append(np.insert(piece.data, piece.offsets[:-1], 0x20), np.uint8(0x20))
    offsets = piece.offsets + np.arange(len(piece.offsets))
    words = split(data, offsets, BLANK_SEPARATED, fold=False)
    single = words.ends - words.starts == 1
    follows = np.zeros(len(single), bool)
    follows[1:] = single[1:] & single[:-1] & (words.starts[1:] == words.ends[:-1] + 1)
    follows[words.first[:-1][np.diff(words.first) > 0]] = False
    begins = np.flatnonzero(~follows)
    last = np.append(begins[1:], len(single)) - 1
    starts = words.starts[begins] - 1
    return data, Units(starts, words.ends[last[: len(begins)]] + 1, np.searchsorted(starts, offsets))


def subsequences(data: np.ndarray, found: Units) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Byte places, subsequence numbers and weights, one gap pattern after the other."""
    n = len(data)
    codes = np.zeros(n + SPAN, np.int32)
    codes[:n] = CODES[data]
    codes[found.starts] = codes[found.ends - 1] = EDGE
    lengths = np.diff(np.concatenate([[0], found.starts, [n]]))
    room = np.repeat(np.append(0, found.ends), lengths) - np.arange(n)
    some = codes > 0
    for a, b in _PATTERNS:
        at = np.flatnonzero((room > b) & some[:n] & some[a : n + a] & some[b : n + b])
        yield at, (codes[at] << 12) | (codes[at + a] << 6) | codes[at + b], DECAY ** (b - 2)


def margins(piece: Piece, weights: np.ndarray, bias: float) -> tuple[np.ndarray, Units, np.ndarray]:
    """The bytes of a piece, its units and their margins."""
    data, found = units(piece)
    dot, norm = np.zeros(len(data) + 1), np.zeros(len(data) + 1)
    for at, number, weight in subsequences(data, found):
        dot[at] += weight * weights[number]
        norm[at] += weight * weight
    if not len(found.starts):
        return data, found, np.zeros(0)
    sums, sizes = np.add.reduceat(dot, found.starts), np.add.reduceat(norm, found.starts)
    return data, found, bias + sums / np.sqrt(np.maximum(sizes, DECAY ** (2 * SPAN)))


def worst(piece: Piece, weights: np.ndarray, bias: float) -> tuple[np.ndarray, list[bytes]]:
    """The largest margin of each text, and the unit that has it."""
    data, found, values = margins(piece, weights, bias)
    texts = piece.hi - piece.lo
    best, strings = np.full(texts, bias), [b""] * texts
    filled = np.flatnonzero(np.diff(found.first) > 0)
    if len(filled):
        best[filled] = np.maximum.reduceat(values, found.first[filled])
        top = np.flatnonzero(values == np.repeat(best, np.diff(found.first)))
        for k, text in zip(top.tolist(), (np.searchsorted(found.first, top, side="right") - 1).tolist()):
            strings[text] = data[found.starts[k] + 1 : found.ends[k] - 1].tobytes()
    return best, strings


class Machine(NamedTuple):
    """A weight for every subsequence, a bias, and the logistic map of margins to scores."""

    weights: np.ndarray
    bias: float
    slope: float
    centre: float

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (values - self.centre), -35.0, 35.0)))


def _vectors(strings: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Subsequence numbers and normalised weights of each string."""
    out = []
    for string in strings:
        data = np.frombuffer(b" " + string + b" ", np.uint8)
        whole = Units(np.array([0]), np.array([len(data)]), np.array([0, 1]))
        numbers, values, size = [], [], 0.0
        for at, number, weight in subsequences(data, whole):
            numbers.append(number)
            values.append(np.full(len(at), weight))
            size += weight * weight * len(at)
        number, value = np.concatenate(numbers), np.concatenate(values)
        at, where = np.unique(number, return_inverse=True)
        total = np.bincount(where, value, len(at)) if len(at) else np.zeros(0)
        out.append((at, total / np.sqrt(max(size, DECAY ** (2 * SPAN)))))
    return out


def train_units(toxic: list[bytes], other: list[bytes], landmarks: list[bytes]) -> tuple[np.ndarray, float]:
    """Subsequence weights and bias of the machine that tells the two lists apart."""
    marks = _vectors(landmarks)
    known = np.unique(np.concatenate([at for at, _ in marks]))

    def dense(vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), len(known)))
        for row, (at, value) in zip(out, vectors):
            place = np.minimum(np.searchsorted(known, at), len(known) - 1)
            hit = known[place] == at
            row[place[hit]] = value[hit]
        return out

    base = dense(marks)
    inner, axes = np.linalg.eigh(base @ base.T)
    kept = inner > 1e-6 * inner.max()
    project = axes[:, kept] / np.sqrt(inner[kept])
    strings = [*toxic, *other]
    parts = [dense(_vectors(strings[k : k + 500])) @ base.T @ project for k in range(0, len(strings), 500)]
    x = np.vstack(parts)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(other))])
    cost = np.where(y > 0, COST * len(y) / (2 * len(toxic)), COST * len(y) / (2 * max(len(other), 1)))
    penalty = np.diag(np.append(np.ones(x.shape[1] - 1), 1e-3))
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps on the examples inside the margin
        inside = y * (x @ w) < 1
        rows = x[inside] * cost[inside, None]
        step = np.linalg.solve(penalty + x[inside].T @ rows, rows.T @ y[inside])
        if np.allclose(step, w):
            break
        w = step
    weights = np.zeros(1 << 18)
    weights[known] = (project @ w[:-1]) @ base
    return weights, float(w[-1])


def _calibrate(values: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and centre of a logistic map; the toxic ones weigh ``share`` of all."""
    weight = np.where(toxic > 0, share / max(toxic.sum(), 1), (1 - share) / max((1 - toxic).sum(), 1))
    a, b = 4.0, 0.0
    for _ in range(200):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * values + b, -35.0, 35.0)))
        g, h = weight * (p - toxic), weight * p * (1 - p) + 1e-12
        gradient = np.array([(g * values).sum() + 1e-4 * a, g.sum()])
        hessian = np.array([[(h * values * values).sum() + 1e-4, (h * values).sum()], [(h * values).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    a = max(a, 1e-3)
    return float(a), float(-b / a)


def _worst_units(rows: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """Label, largest margin and worst unit of every labelled text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, strings = [], []
            for piece in pieces(batch.column("text")):
                best, found = worst(piece, weights, bias)
                values.append(best)
                strings += [unit[:LONGEST_UNIT].lower() for unit in found]
            margin = np.concatenate(values) if values else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(margin), pa.array(strings, pa.binary())],
                names=["label", "margin", "unit"],
            )

    return rows.mapInArrow(run, "label int, margin double, unit binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_per_class: int = MOST_PER_CLASS) -> Machine | None:
    """The machine, from a bounded sample of labelled documents.

    Spark counts the units of the sample; the driver gets bounded lists of units and
    a margin for each document of the sample.
    """
    sample = training_sample(labels, label, most_per_class)
    rows = settle(labelled_documents(docs, sample), "sentences")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    known = labels.filter(F.col(label).isNotNull() & ~is_held_out(F.col("doc_id")))
    share = float(known.agg(F.avg(F.col(label).cast("double"))).first()[0])

    words = F.array_distinct(F.split(lower_ascii(F.col("text")), BLANKS))
    counted = settle(
        rows.select("label", F.explode(words).alias("unit"))
        .filter((F.octet_length("unit") >= 3) & (F.octet_length("unit") <= LONGEST_UNIT))
        .groupBy("unit")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")),
        "units",
    )
    # The least number of toxic documents that hardly any harmless unit reaches by chance.
    rate = sizes[1] / (sizes[0] + sizes[1])
    frequency = counted.groupBy((F.col("toxic") + F.col("other")).alias("n")).agg(F.count(F.lit(1)).alias("units"))
    units_of = {r.n: r.units for r in frequency.filter("n <= 200").collect()}
    least = 2
    while least < 200 and sum(u * rate**n for n, u in units_of.items() if n >= least) > CHANCE_UNITS:
        least += 1

    def take(found: DataFrame, order: list, n: int) -> list[bytes]:
        return [r.unit.encode() for r in found.orderBy(*order, "unit").limit(n).collect()]

    toxic = take(counted.filter((F.col("other") == 0) & (F.col("toxic") >= least)), [F.desc("toxic")], MOST_TOXIC)
    harmless = counted.filter("other > 0")
    other = take(harmless, [F.desc("other")], MOST_FREQUENT) + take(harmless, [F.xxhash64("unit")], MOST_OTHER)
    if not toxic or not other:
        return None
    spaced = [u[:k] + b"x" + u[k:] for u in toxic[:TOXIC_LANDMARKS] for k in range(2, len(u) - 1)]
    marked, hard = toxic[:TOXIC_LANDMARKS] + other[-OTHER_LANDMARKS:], []
    for hard_round in range(HARD_ROUNDS + 1):
        weights, bias = train_units([*toxic, *spaced], [*other, *hard], marked + hard[:HARD_LANDMARKS])
        judged = _worst_units(rows, weights, bias).toPandas()
        clean = judged[(judged["label"] == 0) & (judged["margin"] > -0.5)].sort_values(["margin", "unit"])
        found = dict.fromkeys(map(bytes, clean["unit"][::-1]))
        hard += [u for u in found if u not in {*hard, *toxic}]
    slope, centre = _calibrate(judged["margin"].to_numpy(), judged["label"].to_numpy(float), share)
    return Machine(weights, bias, slope, centre)


def scorer(machine: Machine | None):
    """A function of a text column that gives its score."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if machine is None:
            return pa.array(np.zeros(len(texts)))
        found = [worst(piece, machine.weights, machine.bias)[0] for piece in pieces(texts)]
        return pa.array(machine.scores(np.concatenate(found)) if found else np.zeros(0))

    return score


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score, prediction and fold of every document. Trains when called."""
    score = scorer(train(docs, labels))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )
