"""Phrase collocations against a plain count, whatever the shards, buckets and memory."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timelens.llm import phrases
from timelens.llm.words import pieces

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, support=30, best=2000):
    """(lang, rank, phrase, a, l, r, n, score) by dictionaries."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= support}
    inside = Counter()
    for (lang, ws), a in candidates.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                part = (lang, ws[i : i + size])
                inside[part] = max(inside[part], a)
    found = {}
    for (lang, ws), a in candidates.items():
        if 100 * inside[lang, ws] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(ws)):
            left, right = counts[lang, ws[:k]], counts[lang, ws[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, rows in found.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:best], 1)
    )


def made(seed=0, n=400):
    rng = random.Random(seed)
    common = ["the old stone bridge", "new york city", "over and over", "état de droit", "A B", "x y"]
    rows = [(None, None), ("en", None), ("en", ""), ("en", " \t. ,\n"), (None, "No Language here " * 40)]
    rows += [("en", "again and again " * 3000), ("", "empty name " * 40), ("en", "nul\x00l word\x85 end " * 35)]
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 40)):
            words.append(rng.choice(common) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.8)) % 60}")
            if rng.random() < 0.2:
                words[-1] += rng.choice([".", ",", "\n", "!", "\t", "  ", "\r\n"])
        rows.append((rng.choice(["en", "de", "en"]), " ".join(words)))
    return rows + [("de", "eine kopie von allen")] * 130


def judged(spark, rows, **options):
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("shard", "phrase", "n", "words", "a", "score", "bucket", "part")})
    out = phrases.collocations(docs.repartition(7), **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def test_like_a_plain_count(spark):
    rows = made()
    found = judged(spark, rows)
    assert found == plain(rows) and len(found) > 40
    assert judged(spark, rows, shards=1, best=5) == plain(rows, best=5)
    assert judged(spark, rows, shards=29, support=31) == plain(rows, support=31)


def test_nothing(spark):
    assert judged(spark, []) == [] and judged(spark, [(None, None), ("en", "")]) == []
    assert judged(spark, [("en", "some words")] * 29) == []
    assert [r[2] for r in judged(spark, [("en", "some words")] * 30)] == ["some words"]


def test_memory_and_buckets_change_nothing(spark, monkeypatch):
    rows = made(1, 150)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 1 << 6)
    wanted = plain(rows)
    assert judged(spark, rows) == wanted
    table = phrases.locally_frequent(spark.createDataFrame(rows, "lang string, text string"))
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] or "" for r in rows]})
    sums = []
    for held in (1, 50, 1 << 19):
        total = Counter()
        for out in phrases._counting(table, held)(iter([batch.slice(0, 60), batch.slice(60)])):
            for lang, phrase, size, n in zip(*(c.to_pylist() for c in out.columns)):
                total[lang, phrase, size] += n
        sums.append(total)
    assert sums[0] == sums[1] == sums[2]


def test_small_tasks_mine_the_same(spark):
    texts = pa.array([t or "" for _, t in made(2, 60)])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * len(texts)), texts, pa.array([0] * len(texts), pa.int32())], names=["lang", "text", "shard"]
    )
    def total(held):
        found = Counter()
        for out in phrases._mining(8, 65535, held)(iter([batch])):
            for bucket, _, keys, counts in zip(*(c.to_pylist() for c in out.columns)):
                for k, c in zip(np.frombuffer(keys, np.uint32), np.frombuffer(counts, np.uint16)):
                    found[bucket, int(k)] += int(c)
        return found
    assert total(1) == total(1 << 22)


@pytest.mark.parametrize("text", ["", "a", "a b", "a, b c\nd e f g", "..a..b c"])
def test_phrases_stay_in_their_piece(text):
    for piece in pieces(pa.array([text, "z " + text])):
        found = {size: len(at) for _, _, at, size in phrases._phrases(piece, np.zeros(2, np.uint64))}
        plainly = Counter()
        for own in (text, "z " + text):
            for part in re.split(r"[.,;:!?\x0A-\x0D]", own):
                words = part.split()
                for size in range(1, 5):
                    plainly[size] += max(0, len(words) - size + 1)
        assert {k: v for k, v in found.items() if v} == {k: v for k, v in plainly.items() if v}
