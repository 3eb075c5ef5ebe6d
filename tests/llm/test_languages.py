"""Hyperdimensional profiles: held-out accuracy, a plain version, and awkward rows."""

import math
import os
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.llm import languages
from timelens.llm.tables import read_table

SF_DIR = "/root/testdata/sf0.1"
DOCUMENTS = "doc_id long, lang string, text string"

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@needs_tables
def test_held_out_accuracy(spark):
    docs = read_table(spark, SF_DIR, "documents")
    rows = languages.judge_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 3000 and right / len(rows) >= 0.97
    assert all(0.0 <= r.score <= 1.0 for r in rows)


def letter(code):
    """Signs of one letter, as the operator makes them."""
    return [1 - 2 * int(b) for b in np.unpackbits(languages.letter_signs(np.array([code])).view(np.uint8))]


def plain_runs(text):
    """Runs of three letters by plain text functions."""
    runs = Counter()
    kept = "".join(ch if unicodedata.category(ch)[0] in "LM" else " " for ch in text.lower())
    padded = " " + " ".join(kept.split(" ")) + " "
    while "  " in padded:
        padded = padded.replace("  ", " ")
    for i in range(len(padded) - 2):
        runs[padded[i : i + 3]] += 1
    return runs


def plain_vector(text):
    vector = [0] * languages.DIMENSIONS
    signs = {}
    turn = lambda v, places: v[-64 * places :] + v[: -64 * places] if places else v
    for run, n in plain_runs(text).items():
        parts = [turn(signs.setdefault(ch, letter(ord(ch))), 2 - i) for i, ch in enumerate(run)]
        for j, (a, b, c) in enumerate(zip(*parts)):
            vector[j] += n * a * b * c
    length = math.sqrt(sum(v * v for v in vector)) or 1.0
    return [v / length for v in vector]


TEXTS = {
    "en": ["the house on the hill is old", "they would rather walk through the thin woods", "which of these things"],
    "de": ["das haus auf dem berg ist alt", "sie gehen lieber durch den wald und schauen", "nicht über straßen"],
    "ja": ["これはとても古い家です", "森の中を歩くのが好きです"],
    "hi": ["यह घर बहुत पुराना है", "मुझे जंगल में चलना पसंद है"],
}


def made():
    rows, key = [], 0
    for _ in range(3):
        for lang, texts in TEXTS.items():
            for text in texts:
                rows.append((key, lang, text))
                key += 1
    rows += [(None, "en", "the thing"), (900, None, "das ist der wald"), (901, "en", None), (902, "en", ""), (903, "en", "12 :: 3"), (904, "de", "́́")]
    rows += [(905, "en", "I"), (906, "en", "İSTANBUL \x00 walks"), (5, "de", "das haus"), (5, "de", "das haus"), (907, "en", "the old hill " * 5000)]
    return rows


def test_like_a_plain_version(spark):
    rows = made()
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(4)
    docs = docs.withColumns({c: F.lit("clash") for c in ("score", "bundle", "place", "value", "held_out", "found")})
    found = languages.judge_language(docs)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    sums = {}
    vectors = {text: plain_vector(text or "") for _, _, text in rows if text is None or len(text) < 1000}
    vectors["the old hill " * 5000] = plain_vector("the old hill " * 5000)
    for key, lang, text in rows:
        fold = zlib.crc32(b"" if key is None else str(key).encode()) % 3
        if lang is not None and fold != 1 and any(c.isalpha() for c in text or ""):
            sums.setdefault(lang, np.zeros(languages.DIMENSIONS))
            sums[lang] += np.rint(np.array(vectors[text]) * languages.UNIT)
    wanted = []
    for key, _, text in rows:
        fold = zlib.crc32(b"" if key is None else str(key).encode()) % 3 == 1
        if not any(c.isalpha() for c in text or ""):
            wanted.append((str(key), fold, "und", 0.0))
            continue
        cosines = {k: float(np.dot(vectors[text], v) / np.sqrt(v @ v)) for k, v in sorted(sums.items())}
        best = max(cosines, key=lambda k: cosines[k])
        wanted.append((str(key), fold, best, round(min(max(cosines[best], 0.0), 1.0), 9)))
    got = [(str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9)) for r in found.collect()]
    assert sorted(got) == sorted(wanted)


def test_other_scripts_and_blocks(spark, monkeypatch):
    """Every sentence finds its language, whatever the size of the blocks."""
    rows = [(key, lang, text) for key, (lang, text) in enumerate((la, t) for _ in range(4) for la, ts in TEXTS.items() for t in ts)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    truth = {k: lang for k, lang, _ in rows}
    assert all(truth[r.doc_id] == r.lang_pred for r in languages.judge_language(docs).collect())
    texts = [t for _, _, t in rows]
    whole, _ = languages.text_vectors(texts)
    monkeypatch.setattr(languages, "RUNS", 7)
    small, _ = languages.text_vectors(texts)
    assert np.allclose(whole, small)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(made(), DOCUMENTS)
    assert languages.judge_language(docs.limit(0)).count() == 0
    alone = languages.judge_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)} and len(alone) == len(made())


def test_letters_are_almost_orthogonal():
    signs = languages.run_signs(np.arange(97, 123, dtype=np.uint64) * np.uint64(1 << 42) + np.uint64((97 << 21) + 98))
    products = signs @ signs.T / languages.DIMENSIONS
    assert np.allclose(np.diag(products), 1) and np.abs(products - np.eye(26)).max() < 0.16
