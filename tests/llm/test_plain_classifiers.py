"""The two classifiers against plain versions: updates, scores, kernel, machine and margins."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timelens.llm import quality, toxicity
from timelens.llm.words import gram_hashes, pieces, split

TEXTS = ["one two, two three ### one", "a", "", "x x x x", "Ünïcode wörds\n\tand $$ signs $$", "again and again and again", None]


# Quality: hashed n-grams and follow-the-regularised-leader


def plain_buckets(text):
    """Buckets of words, pairs and skips of one text, one after the other."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    words = split(data, np.array([0, len(data)]), quality.LETTERS_AND_SIGNS, fold=False)
    shift = 64 - quality.BUCKETS_LOG2
    hashes = [int(h) for h in words.hashes]
    found = [h >> shift for h in hashes]
    pairs, at, _ = gram_hashes(words, 2)
    for pair, i in zip(pairs, at):
        found.append(int(quality._SAME if hashes[i] == hashes[i + 1] else pair) >> shift)
    for i in range(len(hashes) - 2):
        found.append(int(quality._AGAIN if hashes[i] == hashes[i + 2] else quality._OTHER) >> shift)
    return found


def plain_shares(text):
    found = plain_buckets(text)
    return {b: quality.SCALE * found.count(b) / len(found) for b in set(found)}


def plain_leader(examples, epochs):
    """The updates coordinate by coordinate, with dictionaries."""
    z, n = {}, {}

    def weight(i):
        lead = z.get(i, 0.0)
        if abs(lead) <= quality.L1:
            return 0.0
        step = (quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2
        return -(lead - math.copysign(quality.L1, lead)) / step

    for _ in range(epochs):
        for shares, label in examples:
            x = {**shares, quality.BUCKETS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_buckets_of_many_texts_at_once():
    for piece in pieces(pa.array(TEXTS)):
        found, ranges = quality.buckets(piece)
        for i, text in enumerate(TEXTS[piece.lo : piece.hi]):
            own = [int(b) for f, r in zip(found, ranges) for b in f[r[i] : r[i + 1]]]
            assert sorted(own) == sorted(plain_buckets(text))


def examples(seed=1, n=60):
    rng = random.Random(seed)
    made = []
    for k in range(n):
        label = k % 2
        words = [rng.choice(["good", "plain", "text"] if label else ["###", "$$", "junk"]) for _ in range(rng.randrange(1, 12))]
        made.append((" ".join(words + [f"w{rng.randrange(20)}"]), label))
    return made


def test_updates_are_those_of_the_plain_rule():
    given = [(plain_shares(text), label) for text, label in examples()]
    wanted = plain_leader(given, 3)
    rows = [(np.array(sorted(s)), np.array([s[b] for b in sorted(s)]), float(label)) for s, label in given]
    found = quality.follow_the_leader(rows, 3)
    assert set(np.flatnonzero(found).tolist()) <= set(wanted)
    for i, w in wanted.items():
        assert found[i] == pytest.approx(w, rel=1e-9, abs=1e-12)


def test_scores_are_dot_products(spark):
    given = [(plain_shares(text), label) for text, label in examples()]
    weights = np.zeros(quality.BUCKETS + 1)
    for i, w in plain_leader(given, 2).items():
        weights[i] = w
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + [t for t, _ in examples(2, 20)])], "doc_id int, text string")
    for row in docs.select("text", quality.scorer(weights)(F.col("text")).alias("score")).collect():
        raw = weights[-1] + sum(v * weights[b] for b, v in plain_shares(row.text).items())
        assert row.score == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-9)


# Toxicity: the subsequence kernel, its machine and its margins


def plain_unit(unit):
    """Normalised weights of a unit's three-letter subsequences, by trying all of them."""
    codes = [toxicity.EDGE, *(int(toxicity.CODES[b]) for b in unit), toxicity.EDGE]
    found = {}
    size = 0.0
    for i, j, k in itertools.combinations(range(len(codes)), 3):
        if k - i < toxicity.SPAN and codes[i] and codes[j] and codes[k]:
            weight = toxicity.DECAY ** (k - i - 2)
            key = (codes[i] << 12) | (codes[j] << 6) | codes[k]
            found[key] = found.get(key, 0.0) + weight
            size += weight * weight
    return {key: v / math.sqrt(max(size, toxicity.DECAY ** (2 * toxicity.SPAN))) for key, v in found.items()}


def plain_kernel(a, b):
    return sum(v * plain_unit(b).get(key, 0.0) for key, v in plain_unit(a).items())


UNITS = [b"dumbhead", b"d.u.m.b", b"filthbag", b"river", b"ab", b"a b c d", b"x1y2z3", "é-été".encode(), b"riverside"]


def test_kernel_is_the_product_of_all_subsequences():
    vectors = toxicity._vectors(UNITS)
    for (at, value), unit in zip(vectors, UNITS):
        wanted = plain_unit(unit)
        assert at.tolist() == sorted(wanted)
        assert value == pytest.approx([wanted[k] for k in sorted(wanted)])
    for i, j in itertools.combinations(range(len(UNITS)), 2):
        both, left, right = np.intersect1d(vectors[i][0], vectors[j][0], return_indices=True)
        product = float(vectors[i][1][left] @ vectors[j][1][right])
        assert product == pytest.approx(plain_kernel(UNITS[i], UNITS[j]))
    assert plain_kernel(b"dumbhead", b"dumbqhead") > 0.5 > plain_kernel(b"dumbhead", b"riverside")


def plain_words(text):
    """Units of a text: words between blanks, runs of single characters as one."""
    found, run = [], []
    for word in (text or "").encode().split():
        if len(word) == 1:
            run.append(word)
            continue
        if run:
            found.append(b" ".join(run))
            run = []
        found.append(word)
    return found + ([b" ".join(run)] if run else [])


def test_machine_folds_into_one_weight_for_each_subsequence():
    """Margins of whole texts, as from landmarks, projection and machine kept apart."""
    rng = random.Random(4)
    toxic = [b"dumbhead", b"filthbag", b"scumling"]
    other = [bytes(rng.choice(b"abcdefghilmnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(40)]
    marks = [*toxic, *other[:10]]
    weights, bias = toxicity.train_units(toxic, other, marks)
    inner = np.array([[plain_kernel(a, b) for b in marks] for a in marks])
    values, axes = np.linalg.eigh(inner)
    kept = values > 1e-6 * values.max()
    project = axes[:, kept] / np.sqrt(values[kept])

    def features(unit):
        return np.array([plain_kernel(unit, m) for m in marks]) @ project

    # The machine is the best one: no small step makes its loss smaller.
    x = np.hstack([[features(u) for u in [*toxic, *other]], np.ones((len(toxic) + len(other), 1))])
    y = np.array([1.0] * len(toxic) + [-1.0] * len(other))
    cost = np.where(y > 0, toxicity.COST * len(y) / (2 * len(toxic)), toxicity.COST * len(y) / (2 * len(other)))
    penalty = np.append(np.ones(x.shape[1] - 1), 1e-3)

    def loss(w):
        return (penalty * w * w).sum() / 2 + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() / 2

    direction = {key: weights[key] for unit in marks for key in plain_unit(unit)}
    folded = np.array([sum(v * direction.get(k, 0.0) for k, v in plain_unit(u).items()) for u in [*toxic, *other]])
    own = np.append(np.linalg.lstsq(x[:, :-1], folded, rcond=None)[0], bias)
    assert x @ own == pytest.approx(folded + bias, abs=1e-6)
    for _ in range(200):
        assert loss(own) <= loss(own + 1e-3 * np.array([rng.gauss(0, 1) for _ in own])) + 1e-9

    texts = ["you dumbhead by the river", "d u m b h e a d", "", "a", "quiet river", None, "filthqbag " * 3]
    for piece in pieces(pa.array(texts)):
        best, strings = toxicity.worst(piece, weights, bias)
        for i, text in enumerate(texts[piece.lo : piece.hi]):
            margins = {u: bias + sum(v * weights[k] for k, v in plain_unit(u).items()) for u in plain_words(text)}
            assert best[i] == pytest.approx(max(margins.values(), default=bias))
            if margins:
                assert margins[strings[i]] == pytest.approx(best[i])
