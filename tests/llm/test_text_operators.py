"""Each operator against a plain version, on rows with every awkward case."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens.llm import (
    components,
    decontaminate,
    hostrules,
    jaccard,
    licenses,
    mixing,
    repeats,
    sharding,
    warc,
)

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def blank_words(text):
    return BLANK_WORDS.findall(text or "")


def plain_words(text):
    return PLAIN_WORDS.findall((text or "").translate(LOWER))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def awkward_rows():
    """Nulls, empties, blanks, a long text, copies, near copies, shared passages, repeats."""
    passage = prose("passage", 60)
    near = prose("near", 120).split()
    rows = [
        (None, None, None, None, None),
        (1, "", "en", "s1", 0),
        (2, " \t\n\x0b\x0c\r ", "en", "s1", 7),
        (3, "one two Three", "en", "s2", 13),
        (4, "ONE two three", "en", "s2", 13),
        (5, prose("long", 30_000), "en", "s1", None),
        (6, "a " * 200, "en", "s1", None),
        (7, "a " * 200, "en", "s1", None),
        (8, passage, "en", "s1", None),
        (9, f"{prose('x', 40)}\n{passage}\n{prose('y', 50)}", "de", "s1", None),
        (10, f"{prose('z', 30)} {passage}Été {prose('u', 30)} {passage}", "fr", None, None),
        (10, "same id, other text", "fr", None, None),
        (11, prose("dup", 80), "en", "s3", None),
        (11, prose("dup", 80), "en", "s3", None),
    ]
    for k in range(40):
        changed = list(near)
        changed[(7 * k) % 120] = f"edit{k}"
        rows.append((100 + k, " ".join(changed), "en", "s1", None))
    rows += [(200 + k, f"{passage} end{k}", "en", f"s{k % 5}", None) for k in range(6)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    made = spark.createDataFrame(rows, DOCUMENTS).repartition(5, "n_chars", "doc_id")
    clash = ("score", "n_words", "fp", "gram", "kept", "shard", "size", "hash", "label", "copies", "of", "n")
    return made.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def collected(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect()) if columns else frame.collect()


def key(value):
    return (value is not None, value or 0)


# Decontamination


def hit_words(text, items):
    words = plain_words(text)
    hit, met = set(), set()
    for item, item_text in items:
        parts = plain_words(item_text)
        size = min(13, len(parts))
        for s in range(len(parts) - size + 1 if size else 0):
            window = parts[s : s + size]
            for i in range(len(words) - size + 1):
                if words[i : i + size] == window:
                    hit.update(range(i, i + size))
                    met.add("" if item is None else str(item))
    return len(words), len(hit), sorted(met)


def test_decontamination(spark, docs, rows, nothing):
    passage = prose("passage", 60).split()
    items = [
        (1, " ".join(passage[5:30])),
        (2, "one, TWO"),
        (2, "Three"),
        (3, None),
        (4, ""),
        (10, " ".join(passage[40:53])),
        (None, " ".join(passage[20:41])),
        (5, " ".join(passage[:12]) + " other"),
        (1, " ".join(passage[5:30])),
        (6, "a a a a a a a a a a a a a a"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("clash"))
    found = decontaminate.judge_contamination(docs, benchmark).collect()
    assert len(found) == len(rows)
    wanted = Counter()
    for doc_id, text, *_ in rows:
        n, hit, met = hit_words(text, items)
        sha = hashlib.sha256(",".join(met).encode()).hexdigest()
        wanted[(doc_id, n, hit, len(met), sha, hit > 0 and 20 * hit >= n)] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(tuple(r[c] for c in columns) for r in found) == wanted
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    clean = sum(n for row, n in wanted.items() if not row[-1])
    assert kept.count() == clean
    assert decontaminate.judge_contamination(nothing, benchmark).count() == 0
    none = decontaminate.judge_contamination(docs, benchmark.limit(0))
    assert {r.n_hit for r in none.collect()} == {0}


# Repeated passages


def test_repeats(docs, rows, nothing):
    starts = Counter()
    for _, text, *_ in rows:
        words = blank_words(text)
        starts.update(tuple(words[i : i + 35]) for i in range(len(words) - 34))
    wanted = Counter()
    for doc_id, text, *_ in rows:
        words = blank_words(text)
        gone = set()
        for i in range(len(words) - 34):
            if starts[tuple(words[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        wanted[(doc_id, len(words), len(gone), kept)] += 1
    found = repeats.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == wanted
    assert sum(r.n_removed for r in found) > 1000
    assert repeats.remove_repeats(nothing).count() == 0


def test_certain_names_are_shared_by_equal_windows():
    """What recompression calls certain for a window does not depend on its surroundings."""
    from timelens.llm.words import BLANK_SEPARATED, split

    inner = prose("inner", 35).split()
    seen = []
    for seed in range(20):
        text = f"{prose(f'l{seed}', seed)} {' '.join(inner)} {prose(f'r{seed}', 20 - seed)}".strip().encode()
        words = split(np.frombuffer(text, np.uint8), np.array([0, len(text)]), BLANK_SEPARATED, False)
        names = repeats.recompress(words)
        held = (names.first >= seed) & (names.last < seed + 35)
        seen.append(set(zip(names.name[held].tolist(), (names.first[held] - seed).tolist())))
    assert seen[0] and all(s == seen[0] for s in seen)


# Host rules


def test_host_rules(docs, rows, nothing):
    judged = []
    for doc_id, text, _, source, _ in rows:
        words, text = blank_words(text), text or ""
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        again = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
        lines = [line for line in text.split("\n") if BLANK_WORDS.search(line)]
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        judged.append(
            (doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
             len(lines) - len(set(lines)), len(again), failed, source)
        )
    hosts = defaultdict(list)
    for row in judged:
        hosts[row[-1]].append(row[-2])
    rates = [sum(v) / len(v) for v in hosts.values()]
    mean = sum(rates) / len(rates)
    variance = sum((r - mean) ** 2 for r in rates) / len(rates)
    strength = max(mean * (1 - mean) / variance - 1, 1.0)
    bad = {h for h, v in hosts.items() if (sum(v) + mean * strength) / (len(v) + strength) > 0.5}
    wanted = Counter((*row[:-1], not row[-2] and row[-1] not in bad) for row in judged)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = hostrules.judge_documents(docs).collect()
    assert Counter(tuple(r[c] for c in columns) for r in found) == wanted
    assert hostrules.judge_documents(nothing).count() == 0


def test_a_failing_host_loses_its_documents(spark):
    rows = [(k, "too short" if k < 80 else prose(k, 40), "bad") for k in range(100)]
    rows += [(1000 + k, prose(k, 50), f"good{k % 9}") for k in range(180)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in hostrules.judge_documents(made).filter("kept").collect()}
    assert kept == {1000 + k for k in range(180)}


# Sharding


def test_sharding(docs, rows, nothing):
    found = sharding.shard_documents(docs).collect()
    assert len(found) == len(rows)
    wanted = Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == wanted
    slots = defaultdict(list)
    by_key = defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        by_key[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 8)
    assert all(len(v) == 1 for v in by_key.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_weights_share_the_keys(spark):
    keys = spark.range(6000).select(F.col("id").alias("key"))
    shards = keys.select(sharding.rendezvous(F.col("key"), [1.0, 2.0, 0.0, 3.0]).alias("shard"))
    counts = {r.shard: r["count"] for r in shards.groupBy("shard").count().collect()}
    assert set(counts) == {0, 1, 3}
    assert abs(counts[3] / counts[0] - 3) < 0.5 and abs(counts[1] / counts[0] - 2) < 0.4


# Mixing


def targets_of(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        level = rest / share if share else 0
        over = {s for s in names if s not in full and 2 * sizes[s] < level * weight[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mixing(docs, rows, nothing):
    sizes, source_of = Counter(), {}
    for doc_id, text, _, source, _ in rows:
        sizes[source] += len(blank_words(text))
        source_of[doc_id] = source
    wanted = targets_of(sizes)
    found = mixing.mixed_documents(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((d, len(blank_words(t))) for d, t, *_ in rows)
    taken, longest = Counter(), Counter()
    for r in found:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(wanted[source])
        assert r.taken <= 2 * r["size"]
        taken[source] += r.taken
        longest[source] = max(longest[source], r["size"])
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= longest[source] / 2 + 1
    assert mixing.mixed_documents(nothing).count() == 0
    again = mixing.mixed_documents(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.taken, r.first_position) for r in found) == Counter(
        (r.doc_id, r.taken, r.first_position) for r in again
    )
    mix = mixing.take_mix(docs)
    assert mix.columns == docs.columns
    assert sum(len(blank_words(r.text)) for r in mix.collect()) == sum(r.taken for r in found)
    assert mixing.take_mix(nothing).count() == 0


def test_rows_of_one_doc_id_take_their_own_positions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 4)
    rows = [(k, prose(k, 20 + k % 7), "en", f"s{k % 3}", None) for k in range(60)]
    rows += [(7, prose(f"other{k}", 30), "en", f"s{k % 4}", k) for k in range(20)]
    rows += [(None, prose(f"nameless{k}", 25), "en", f"s{k % 3}", None) for k in range(30)]
    rows += [(7, prose("same", 30), "en", "s1", None)] * 11 + [(90, "", "en", "s0", None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5).withColumn("size", F.lit("clash"))
    wanted = Counter()
    for r in mixing.place_documents(docs).collect():
        if r["size"]:
            wanted[(r.doc_id, r.source, r["size"])] += len(r.positions)
    mix = mixing.take_mix(docs)
    assert mix.columns == docs.columns
    found = [tuple(r)[:5] for r in mix.collect()]
    assert Counter((d, s, len(blank_words(t))) for d, t, _, s, _ in found) == +wanted
    given = Counter(rows)
    assert all(n <= 2 * given[row] for row, n in Counter(found).items())


def test_moments_invert_the_schedule(spark):
    schedule = (6.0, 5.0, 1.0, 1.0)
    areas = mixing.areas(schedule)
    parts = [k / 50 for k in range(51)]
    made = spark.createDataFrame([(p,) for p in parts], "part double")
    found = [r.t for r in made.select(mixing.moment(F.col("part"), schedule).alias("t")).collect()]
    for part, t in zip(parts, found):
        k = min(int(t * 3), 2)
        x = t - k / 3
        area = areas[k] + schedule[k] * x + (schedule[k + 1] - schedule[k]) * 3 * x * x / 2
        assert area / areas[-1] == pytest.approx(part, abs=1e-9)


# Jaccard join


def shingles(text):
    words = blank_words((text or "").translate(LOWER))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [shingles(text) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    out = Counter()
    for i, (doc_id, *_) in enumerate(rows):
        known = [d for d in groups[top(i)] if d is not None]
        out[(doc_id, len(sets[i]), min(known) if known else None)] += 1
    return out


def brute_groups(rows):
    """The places of the rows of every component."""
    sets = [shingles(text) for _, text, *_ in rows]
    groups = []
    for i, a in enumerate(sets):
        met = [g for g in groups if any(a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]) for j in g)]
        groups = [g for g in groups if g not in met] + [tuple(sum(map(list, met), [i]))]
    return groups


def test_jaccard_join(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 10)
    found = jaccard.link_documents(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows)
    assert jaccard.link_documents(nothing).count() == 0


def test_texts_of_one_doc_id_are_fetched_once_each(spark, monkeypatch):
    """A doc_id with many texts, some in repeated rows: no text comes with another's set."""
    base = prose("hot", 100)
    rows = [(None, f"{base} end{k}") for k in range(12)] + [(5, f"{base} tail{k // 4}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    fetched, compared = [], []

    def settled(frame, name, kept=jaccard.settle):
        out = kept(frame, name)
        if name == "texts":
            fetched.append(Counter(r.fp for r in out.collect()))
        return out

    def read(docs, chosen, texts=jaccard.texts_of):
        out = texts(docs, chosen)
        compared.append(Counter(r.fp for r in out.collect()))
        return out

    monkeypatch.setattr(jaccard, "_of_class", lambda batches: batches)  # all that the join emits
    monkeypatch.setattr(jaccard, "settle", settled)
    monkeypatch.setattr(jaccard, "texts_of", read)
    found = jaccard.link_documents(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == {(None, 5): 12, (5, 5): 12}
    copies = Counter(rows)
    assert fetched[0] and sorted(fetched[0].values()) == sorted(copies.values())
    assert set(compared[0].values()) == {1} and len(compared[0]) == len(copies)


def test_one_row_of_every_component_stays(spark, rows):
    near, alone = rows[14][1], prose("unique", 70)
    odd = [
        (None, near, "en", "s1", None),
        (None, near, "de", "s1", None),
        (130, alone, "en", "s1", None),
        (100, near, "fr", "s9", None),
        (None, f"{alone} end", "en", "s1", None),
        (None, prose("nameless", 60), "en", "s1", None),
        (None, prose("nameless", 60), "en", "s1", None),
        (1, "", "en", "s1", 0),
    ]
    given = rows + odd
    made = spark.createDataFrame(given, DOCUMENTS).repartition(4, "lang", "doc_id")
    made = made.withColumns({c: F.lit("clash") for c in ("n", "_signature", "_whole", "_row", "kept", "_of_slot")})
    found = jaccard.keep_one(made)
    assert found.columns == made.columns
    kept = Counter(tuple(r)[:5] for r in found.collect())
    assert not kept - Counter(given)
    groups = brute_groups(given)
    for group in groups:
        members = [given[i] for i in group]
        stays = [row for row in members if kept[row]]
        named = [row[0] for row in members if row[0] is not None]
        assert {row[0] for row in stays} == {min(named) if named else None}
        if shingles(members[0][1]):
            assert sum(kept[row] for row in set(members)) == 1
    assert sum(kept.values()) == len(groups)
    assert kept[(130, alone, "en", "s1", None)] == 1
    assert jaccard.keep_one(made.limit(0)).count() == 0


def test_prefixes_hold_the_first_shared_column():
    for n in range(1, 200):
        assert jaccard.prefix_length(n) == n - -(-3 * n // 4) + 1


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(40)] + [(101, 100), (100, 102), (7, 7)]
    made = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.component for r in components.connected(made).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}


# Licenses


def test_licenses(spark, nothing):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, f"{prose(1, 30)}\nReleased under the MIT License.\n{prose(2, 30)} under, the MIT license"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "cc-by-nc CC BY NC"),
        (4, f"{prose(3, 500)} {gpl} {prose(4, 9)}"),
        (5, gpl.replace("This work is ", "This book was ")),
        (6, gpl.replace("GNU General Public License, version 3", "terms of our own")),
        (7, None),
        (8, ""),
        (9, "under the mit  licence, the license mit under"),
        (9, "under the mit  licence, the license mit under"),
        (10, prose(5, 20_000)),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash"))
    found = licenses.scan_licenses(made).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert (by_id[1].n_base, by_id[1].first_word, by_id[1].last_word) == (2, 31, 65)
    assert by_id[1].labels == by_id[1].base_labels == "mit"
    assert (by_id[2].labels, by_id[3].n_base, by_id[3].labels) == ("apache-2", 2, "cc-by-nc")
    assert (by_id[4].base_labels, by_id[4].labels, by_id[4].score) == ("", "gpl-3", 1.0)
    assert by_id[5].labels == "" and by_id[6].labels == "" and by_id[9].labels == ""
    for k in (7, 8):
        assert (by_id[k].n_words, by_id[k].n_base, by_id[k].first_word, by_id[k].score) == (0, 0, None, 0.0)
    assert by_id[10].n_words == 20_000
    assert licenses.scan_licenses(nothing).count() == 0


def test_notices_are_found_like_by_trying_every_block(spark):
    notice = licenses.NOTICES[3][0].split()
    rng = random.Random(5)
    rows = []
    for k in range(120):
        words = [w for w in notice if rng.random() < 0.9]
        rng.shuffle(words)
        filler = [f"f{rng.randrange(9)}" for _ in range(rng.randrange(6))]
        for w in filler:
            words.insert(rng.randrange(len(words) + 1), w)
        rows.append((k, " ".join(words)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in licenses.scan_licenses(made, phrases=(), notices=licenses.NOTICES[3:4]).collect()}
    wanted, size = set(notice), len(set(notice))
    for k, text in rows:
        words = text.split()
        best = max(len(wanted & set(words[i : i + len(notice)])) for i in range(len(words)))
        assert found[k] == (best / size if best >= np.ceil(licenses.CONTAINED * size) else 0.0)


@pytest.mark.parametrize("contained", [0.5, 0.85, 1.0])
def test_a_long_text_of_template_words_is_linear(contained):
    """Every block of a text of nothing but notice words, and quickly."""
    import time

    notice = licenses.NOTICES[1]
    template = licenses.templates([notice], contained)[0]
    order = np.sort(template.words)
    rng = random.Random(3)
    vocabulary = notice[0].split()

    def share(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        split = licenses.split(data, np.array([0, len(data)]), licenses.ALPHANUMERIC, fold=True)
        used = np.flatnonzero(np.isin(split.hashes, template.words))
        return licenses._met(split, 0, template, order, used)

    for n in (template.needed, 30, 120):
        for _ in range(20):
            words = [rng.choice([*vocabulary, "x", "y"]) for _ in range(n)]
            if not set(words) & set(vocabulary):
                continue
            best = max(len(set(vocabulary) & set(words[i : i + template.length])) for i in range(len(words)))
            assert share(words) == (best / len(order) if best >= template.needed else 0.0)
    began = time.process_time()
    assert share([rng.choice(vocabulary) for _ in range(200_000)]) > 0 or contained == 1.0
    assert time.process_time() - began < 2


# WARC


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é" + "x" * 300_000
    rows = [
        (1, "http://a/", "<html>same</html>"),
        (2, "http://b/\r\nWARC-Type: evil", "<html>same</html>"),
        (3, None, None),
        (4, "", ""),
        (5, "http://c/", long),
        (6, "http://d/", "line\r\n\r\nWARC/1.1\r\n\r\n"),
        (7, "http://a/", "<html>same</html>"),
        (8, "http://e/", "<html>other</html>"),
        (8, "http://e/", "<html>other</html>"),
        (None, "http://f/", "without an id"),
        (None, "http://a/", "<html>same</html>"),
        (None, "http://h/", "two without an id"),
        (None, "http://h/", "two without an id"),
    ]
    rows += [(100 + k, f"http://g/{k}", f"<html>{prose(k, 300)}</html>") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit("clash"))
    path = f"file://{tmp_path}/archives"
    archives = warc.write_archives(pages, path, archive_bytes=150_000)
    assert archives.count() > 1
    found = warc.read_archives(archives).collect()
    assert len(found) == len(rows)
    payloads = defaultdict(set)
    for page_id, _, html in rows:
        payloads[html or ""].add(page_id if page_id is not None else -1)
    wanted = Counter()
    for page_id, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        last = max(payloads[html or ""])
        revisit = last != -1 and page_id != last
        wanted[(page_id, len(data), digest, "revisit" if revisit else "response", last if revisit else None)] += 1
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[c] for c in columns) for r in found) == wanted
    by_id = {r.page_id: r for r in found}
    assert bytes(by_id[5].payload).decode() == long and bytes(by_id[6].payload) == b"line\r\n\r\nWARC/1.1\r\n\r\n"
    assert bytes(by_id[1].payload) == b""
    one = warc.archive_pages(pages, path, least_revisit=10**6)
    assert {r.record_type for r in one.collect()} == {"response"}
    assert warc.archive_pages(pages.limit(0), path).count() == 0


def test_empty_and_repeated_pages_are_spread_and_read_by_many_tasks(spark, tmp_path):
    rows = [(1, "http://a/" + "long/" * 40, "")] * 3000 + [(k, "http://b/", None) for k in range(2, 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    archives = warc.write_archives(pages, f"file://{tmp_path}/new/archives", archive_bytes=100_000)
    records = [r.records for r in archives.collect()]
    assert len(records) >= 10 and max(records) < 2 * sum(records) / len(records)
    found = warc.read_archives(archives)
    assert found.rdd.getNumPartitions() == len(records)
    assert found.filter("record_type = 'response'").count() == 1 and found.count() == len(rows)


def test_an_archive_starts_with_its_dictionary(tmp_path):
    import struct

    import zstandard

    writer = warc.ArchiveWriter(f"file://{tmp_path}/one.warc.zst")
    records = [warc.record(k, f"u{k}", prose(k, 50).encode(), b"\0" * 20, "response", None) for k in range(50)]
    for data in records:
        writer.add(data)
    writer.close()
    raw = (tmp_path / "one.warc.zst").read_bytes()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    # The first record can be read by itself.
    assert zstandard.ZstdDecompressor(dict_data=trained).decompressobj().decompress(raw[8 + size :]) == records[0]
    assert list(warc.read_archive(f"file://{tmp_path}/one.warc.zst")) == records
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one.warc.zst"]
