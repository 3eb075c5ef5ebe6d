"""License scans: fixed phrases, and an exact set-similarity join with license notices.

A template is the set of words of a notice, a text block any run of words as long as
the notice (or the whole text if that is shorter). A block meets a template if it
holds at least ``CONTAINED`` of its distinct words. Template words are put in order of
how often all documents use them, the rarest first. A block that meets a template
holds one of the first words of that order (prefix filter), the text has as many words
as are needed (length filter), and the words from the block's rarest one on must
suffice (positional filter); only blocks around such words are counted.

The phrases are places where words stand one after the other. They give labels by
themselves; the notices add theirs.

Empty tables give empty results. Null and empty texts have no words, places or labels.
Repeated rows are scanned alike. Other columns are ignored. Words are compared by
64-bit hashes, and phrases then word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelens.llm.words import ALPHANUMERIC, Words, pieces, split

# Phrases with their labels, and notices with theirs.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
NOTICES = (
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
        "bsd",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mpl-2",
    ),
)
#: Share of a template's distinct words that a block must hold.
CONTAINED = 0.85


def words_of(text: bytes) -> list[bytes]:
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(rb"[0-9a-z\x80-\xff]+", lowered)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return split(data, np.array([0, len(data)]), ALPHANUMERIC, fold=True).hashes


class Template(NamedTuple):
    label: str
    length: int
    needed: int
    words: np.ndarray


def templates(notices=NOTICES, contained: float = CONTAINED) -> list[Template]:
    found = []
    for text, label in notices:
        hashes = _hashes(text)
        words = np.unique(hashes)
        found.append(Template(label, len(hashes), int(np.ceil(contained * len(words) - 1e-9)), words))
    return found


def _piece_words(batch: pa.RecordBatch):
    for piece in pieces(batch.column("text")):
        yield piece, split(piece.data, piece.offsets, ALPHANUMERIC, fold=True)


def word_counts(docs: DataFrame, known: np.ndarray) -> dict[int, int]:
    """How often all documents use each of the few template words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, words in _piece_words(batch):
                at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
                total += np.bincount(at[known[at] == words.hashes], minlength=len(known))
        yield pa.RecordBatch.from_arrays(
            [pa.array(known.view(np.int64)), pa.array(total)], names=["word", "times"]
        )

    counted = docs.select("text").mapInArrow(run, "word long, times long")
    rows = counted.groupBy("word").agg(F.sum("times").alias("times")).collect()
    return {int(np.int64(r.word).astype(np.uint64)): r.times for r in rows}


def _met(words: Words, text: int, template: Template, order: np.ndarray, places: np.ndarray) -> float:
    """The largest contained share of a block of a text, 0 if none meets the template.

    ``order`` is the template's words by frequency, ``places`` the words of the text
    that are among them. Of blocks that hold the same template words, the one that
    begins with the first of them is counted. All blocks are looked at together, one
    place after the other, so the work is the text's places times a notice's length.
    """
    size, lo, hi = len(order), words.first[text], words.first[text + 1]
    if hi - lo < template.needed:  # length filter
        return 0.0
    rank = np.argsort(order, kind="stable")
    ranks = rank[np.searchsorted(order[rank], words.hashes[places])]
    ends = np.searchsorted(places, places + template.length)
    rare = np.concatenate([[0], np.cumsum(ranks <= size - template.needed)])
    begins = np.flatnonzero(rare[ends] > rare[:-1])  # prefix filter
    rarest, steps = np.full(len(begins), size), range(int((ends - np.arange(len(ends))).max()))
    for step in steps:
        here = begins + step
        inside = here < ends[begins]
        rarest[inside] = np.minimum(rarest[inside], ranks[here[inside]])
    begins = begins[size - rarest >= template.needed]  # positional filter
    # A word counts at its first place in a block: the one before it lies before the block.
    before = np.full(len(ranks), -1)
    sorted_places = np.argsort(ranks, kind="stable")
    again = np.flatnonzero(ranks[sorted_places[1:]] == ranks[sorted_places[:-1]])
    before[sorted_places[again + 1]] = sorted_places[again]
    counts = np.zeros(len(begins), np.int64)
    for step in steps:
        here = begins + step
        inside = here < ends[begins]
        counts[inside] += before[here[inside]] < begins[inside]
    best = int(counts.max(initial=0))
    return best / size if best >= template.needed else 0.0


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, contained: float = CONTAINED) -> DataFrame:
    """Phrase places, labels and the best containment of every document.

    Counts the template words over all documents when called; the driver gets one
    number for each of them.
    """
    marks = templates(notices, contained)
    known = np.unique(np.concatenate([t.words for t in marks]))
    counts = word_counts(docs, known)
    orders = [
        np.array(sorted(t.words.tolist(), key=lambda w: (counts.get(w, 0), w)), np.uint64) for t in marks
    ]
    prefixes = [o[: len(o) - t.needed + 1] for o, t in zip(orders, marks)]
    spelled = [(words_of(text.encode()), _hashes(text), label) for text, label in phrases]
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_base", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
            T.StructField("base_labels", T.StringType()),
            T.StructField("labels", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def phrase_places(piece, words: Words) -> Iterator[tuple[int, int, str]]:
        """(text, place, label) of every place of a phrase."""
        owner = words.owners()
        for parts, hashes, label in spelled:
            at = np.flatnonzero(words.hashes == hashes[0])
            for k in range(1, len(hashes)):
                at = at[at + k < len(words.hashes)]
                at = at[words.hashes[at + k] == hashes[k]]
            at = at[owner[at] == owner[np.minimum(at + len(hashes) - 1, len(owner) - 1)]] if len(at) else at
            for p in at.tolist():
                said = words_of(piece.data[words.starts[p] : words.ends[p + len(parts) - 1]].tobytes())
                if said == parts:
                    text = int(owner[p])
                    yield text, int(p - words.first[text]), label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema.fields[1:]}
            for piece, words in _piece_words(batch):
                texts = piece.hi - piece.lo
                places: list[list[int]] = [[] for _ in range(texts)]
                base: list[set] = [set() for _ in range(texts)]
                for text, place, label in phrase_places(piece, words):
                    places[text].append(place)
                    base[text].add(label)
                added: list[set] = [set() for _ in range(texts)]
                score = [1.0 if b else 0.0 for b in base]
                owner = words.owners()
                for template, order, prefix in zip(marks, orders, prefixes):
                    rare = np.flatnonzero(np.isin(words.hashes, prefix))
                    if not len(rare):
                        continue
                    used = np.flatnonzero(np.isin(words.hashes, template.words))
                    for text in np.unique(owner[rare]).tolist():
                        own = used[
                            np.searchsorted(used, words.first[text]) : np.searchsorted(used, words.first[text + 1])
                        ]
                        share = _met(words, text, template, order, own)
                        if share:
                            added[text].add(template.label)
                            score[text] = max(score[text], share)
                rows["n_words"] += words.counts().tolist()
                rows["n_base"] += [len(p) for p in places]
                rows["first_word"] += [min(p) if p else None for p in places]
                rows["last_word"] += [max(p) if p else None for p in places]
                rows["base_labels"] += [",".join(sorted(b)) for b in base]
                rows["labels"] += [",".join(sorted(b | a)) for b, a in zip(base, added)]
                rows["score"] += score
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(v, kind) for v, kind in zip(rows.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *rows])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
