"""The prefix trie against a plain one, with shards, bands and queues of every size."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from timelens.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [t[2] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        source = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(source, [])[:h] + turns[c][h:]
    nodes = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    found = []
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        last = len(node[-1][1]) if node else 0
        saved[node] = (len(nodes[node]) - 1) * last + sum(saved[b] for b in below)
        ends = ",".join(str(c) for c in sorted(nodes[node]) if len(rebuilt[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        found.append((min(nodes[node]), len(node), parent, len(nodes[node]), len(below), leaves[node], saved[node], digest))
    return sorted(found, key=str)


def made(seed=0, n=120):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "lost"), (None, None, None, None), (7, None, None, None), (7, None, "user", "first")]
    rows += [(-3, 0, "user", "minus"), (-100, 0, "user", "base"), (-150, 2, "user", "x"), (205, 1, "user", "short")]
    rows += [(300, 3, "same", "tie"), (300, 3, "same", "tie"), (300, 3, "other", "tie"), (300, 3, None, "tie")]
    for c in range(n):
        for turn in range(rng.randrange(0, 9)):
            rows.append((c * 3 % 400, turn, ("user", "assistant")[turn % 2], rng.choice(["hi", "é" * 5, "", None, "go on"])))
    rows += [(1000 + k, t, "user", f"common {t}") for k in range(100) for t in range(4)]
    rows += [(1200, t, "user", f"long talk {t}") for t in range(300)] + [(1201, t, "user", f"long talk {t}") for t in range(150)]
    rng.shuffle(rows)
    return rows


def judged(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clash = ("shard", "depth", "name", "parent", "top", "part", "row", "place", "source", "turns", "ends")
    out = prefixes.prefix_trie(table.withColumns({c: F.lit("clash") for c in clash}), **options)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"shard_rows": 20, "band": 3, "held": 2}, {"shard_rows": 0, "band": 64}, {"shard_rows": 100, "band": 1}])
def test_like_a_plain_trie(spark, options):
    rows = made()
    found = judged(spark, rows, **options)
    assert found == plain(rows) and max(r[1] for r in found) >= 300


def test_nothing(spark):
    assert judged(spark, []) == [] and judged(spark, [(None, 1, "user", "x")]) == []
    alone = judged(spark, [(201, 0, None, None)])
    assert alone == plain([(201, 0, None, None)])


def test_one_conversation_holds_a_third(spark):
    rows = [(500, t, "user", "more") for t in range(3000)] + [(500, 7, "user", "more")] * 500
    rows += [(600 + k, t, "user", f"say {k % 7} {t}") for k in range(100) for t in range(70)]
    assert judged(spark, rows, shard_rows=200, band=16) == plain(rows)
    turns = prefixes.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    assert turns.count() == len(rows)


def test_queue_spills_and_keeps_order():
    rng = random.Random(3)
    keys = [(-rng.randrange(20), f"n{rng.randrange(30)}") for _ in range(3000)]
    queue = prefixes.SpillingQueue(held=40)
    for i, key in enumerate(keys):
        queue.push((*key, i, 1))
    assert queue.runs > 50
    for key in sorted(set(keys)):
        assert sorted(m[2] for m in queue.pop(key)) == [i for i, k in enumerate(keys) if k == key]
    assert len(queue) == 0


def test_long_lists_of_ends_have_many_parts(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PART_BYTES", 64)
    rows = [(c, 0, "user", "same") for c in range(100_000, 100_400)]
    assert judged(spark, rows) == plain(rows)
