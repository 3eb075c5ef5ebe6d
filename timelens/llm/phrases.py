"""Phrase collocations: SON partitioning, then exact counts and scores.

Documents are dealt to ``SHARDS`` shards by their text. Every shard is mined completely
for phrases of 1 to ``LONGEST`` words at a support lowered in proportion to its share of
all bytes: a phrase found ``support`` times in all reaches that share in one shard at
least, whatever the shards are. A shard is mined by many tasks: each sorts and counts
the phrases of its texts, cuts them into buckets by hash, and a bucket is summed shard
by shard where it meets. The locally frequent phrases of all shards are united in a
table of ``2 ** SLOTS_LOG2`` bits, whose size does not grow with the input. A second
pass over the texts counts all phrases with their bit set, by language and text, so
the counts are exact: hashes decide only what is counted, and no frequent phrase has
its bit unset.

Texts are lower-cased (A-Z), split at ``[.,;:!?]`` and line ends into pieces and at
blanks and tabs into words. Null and empty texts have no word; a null language counts
as ``und``; repeated rows count again. Empty tables give empty results. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelens.llm.tables import settle
from timelens.llm.words import Piece, Words, _classes, mix, pieces, run_hashes, split

LONGEST = 4
SUPPORT = 30
SHARDS = 6
BEST = 2000
#: A longer candidate with this many percent of a candidate's count replaces it.
INSIDE_PERCENT = 80
#: Scores are parts of this number.
SCALE = 2_000_000
#: Bits of the table of locally frequent phrases.
SLOTS_LOG2 = 26
#: Phrases that a task holds before it counts them and sends them on.
HELD = 1 << 20
#: Bytes of text for each bucket, and the fewest buckets. A row of a bucket is then
#: about a kilobyte, and a batch of rows some megabytes.
BUCKET_BYTES, BUCKETS_LOG2 = 1 << 23, 11

_IN_WORDS = _classes(lambda b: b not in b" \t.,;:!?\n\x0b\x0c\r")
_ENDS_PIECE = _classes(lambda b: b in b".,;:!?\n\x0b\x0c\r")


def _lang(lang: str | None) -> bytes:
    return b"und" if lang is None else lang.encode()


def _seeds(langs: list[str | None]) -> np.ndarray:
    """A number for every language, from its bytes."""
    known: dict[str | None, int] = {}
    for lang in langs:
        if lang not in known:
            data = np.frombuffer(_lang(lang), np.uint8)
            whole = run_hashes(data.astype(np.uint64) + np.uint64(1), np.array([0]), np.array([len(data)]))
            known[lang] = int(whole[0])
    return np.array([known[lang] for lang in langs], np.uint64)


def _phrases(piece: Piece, seeds: np.ndarray) -> Iterator[tuple[Words, np.ndarray, np.ndarray, int]]:
    """For every length: the words, hashes of all phrases, their first words, the length."""
    words = split(piece.data, piece.offsets, _IN_WORDS, fold=True)
    n = len(words.hashes)
    if n == 0:
        return
    owners = words.owners()
    ended = np.concatenate([[0], np.cumsum(_ENDS_PIECE[piece.data], dtype=np.int64)])
    # Words of one text and piece share a number; it grows along the texts.
    changes = np.zeros(n, np.int64)
    changes[1:] = (owners[1:] != owners[:-1]) | (ended[words.starts[1:]] != ended[words.ends[:-1]])
    run = np.cumsum(changes)
    for size in range(1, LONGEST + 1):
        if n < size:
            return
        at = np.flatnonzero(run[: n - size + 1] == run[size - 1 :])
        hashes = mix(run_hashes(words.hashes, at, at + size) ^ seeds[owners[at]])
        yield words, hashes, at, size


def _counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    ordered = np.sort(hashes)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _mining(buckets_log2: int, most: int, held: int = HELD) -> Callable:
    """A task's phrases as rows (bucket, shard, hashes, counts).

    Of a hash its bucket and the 32 bits that follow are kept: equal phrases stay
    equal. Counts stop at ``most``, the full support, which every shard's support
    is at most.
    """
    rest = np.uint64(64 - buckets_log2 - 32)

    def send(waiting: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for shard in sorted(waiting):
            keys, counts = _counted(np.concatenate(waiting[shard]))
            counts = np.minimum(counts, most).astype(np.uint16)
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            low = keys.astype(np.uint32)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            last = np.append(first[1:], len(bucket))
            for lo in range(0, len(first), 256):
                cuts = list(zip(first[lo : lo + 256], last[lo : lo + 256]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[first[lo : lo + 256]]),
                        pa.array([shard] * len(cuts), pa.int32()),
                        pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()),
                        pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary()),
                    ],
                    names=["bucket", "shard", "hashes", "counts"],
                )
        waiting.clear()

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        number = 0
        for batch in batches:
            seeds = _seeds(batch.column("lang").to_pylist())
            shards = batch.column("shard").to_numpy()
            for piece in pieces(batch.column("text")):
                own = shards[piece.lo : piece.hi]
                for words, hashes, at, _ in _phrases(piece, seeds[piece.lo : piece.hi]):
                    of = own[words.owners()[at]]
                    keys = hashes >> rest
                    for shard in np.unique(of):
                        waiting.setdefault(int(shard), []).append(keys[of == shard])
                    number += len(keys)
                if number >= held:
                    yield from send(waiting)
                    number = 0
        yield from send(waiting)

    return mine


def _uniting(buckets_log2: int, supports: dict[int, int]) -> Callable:
    """Bits of the locally frequent phrases of all shards, a row for each bucket.

    Rows come sorted by bucket, so one bucket is in memory at a time.
    """
    per_bucket = SLOTS_LOG2 - buckets_log2  # log2 of a bucket's slots; below 0 buckets share one

    def of_bucket(rows: dict[int, list[tuple[bytes, bytes]]]) -> np.ndarray:
        """Slots, counted from the first of the bucket's, of what is frequent in a shard."""
        found = []
        for shard, parts in rows.items():
            keys = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in parts])
            counts = np.concatenate([np.frombuffer(c, np.uint16) for _, c in parts]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            frequent = np.add.reduceat(counts, first) >= supports[shard]
            found.append(keys[first[frequent]])
        keys = np.concatenate(found)
        if per_bucket <= 0:
            return np.zeros(min(len(keys), 1), np.uint32)
        return np.unique(keys >> np.uint32(32 - per_bucket))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, {}

        def row() -> Iterator[pa.RecordBatch]:
            slots = of_bucket(rows).astype(np.int64)
            if len(slots):
                base = current << per_bucket if per_bucket >= 0 else current >> -per_bucket
                data = [pa.array([base]), pa.array([slots.astype(np.uint32).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(data, names=["base", "slots"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "shard", "hashes", "counts")]
            for bucket, shard, hashes, counts in zip(*columns):
                if bucket != current and current is not None:
                    yield from row()
                    rows = {}
                current = bucket
                rows.setdefault(shard, []).append((hashes, counts))
        if current is not None:
            yield from row()

    return unite


_BLOCK_LOG2 = 16


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots as bytes of bits, a row for each block of ``2 ** _BLOCK_LOG2`` slots.

    Rows come in the order of their slots.
    """
    current, bits = None, np.zeros(1 << _BLOCK_LOG2, bool)

    def row() -> pa.RecordBatch:
        data = [pa.array([current]), pa.array([np.packbits(bits).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(data, names=["block", "bits"])

    for batch in batches:
        for base, slots in zip(batch.column("base").to_pylist(), batch.column("slots").to_pylist()):
            at = np.frombuffer(slots, np.uint32).astype(np.int64) + base
            for block in np.unique(at >> _BLOCK_LOG2).tolist():
                if block != current:
                    if current is not None:
                        yield row()
                    current, bits = block, np.zeros(1 << _BLOCK_LOG2, bool)
                own = at[at >> _BLOCK_LOG2 == block]
                bits[own - (block << _BLOCK_LOG2)] = True
    if current is not None:
        yield row()


def _united(rows: Iterator[tuple[int, bytes]]) -> np.ndarray:
    """The whole table of bits from its blocks."""
    table = np.zeros(1 << (SLOTS_LOG2 - 3), np.uint8)
    size = 1 << (_BLOCK_LOG2 - 3)
    for block, bits in rows:
        table[block * size : (block + 1) * size] |= np.frombuffer(bits, np.uint8)
    return table


def locally_frequent(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> np.ndarray:
    """Bits of all phrases that are frequent in one of the shards at least.

    Runs jobs when called. The driver gets ``2 ** SLOTS_LOG2`` bits, each block once.
    """
    dealt = _dealt(docs, shards)
    sizes = {r.shard: r.size for r in dealt.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    total = sum(s or 0 for s in sizes.values())
    if not total:
        return np.zeros(1 << (SLOTS_LOG2 - 3), np.uint8)
    supports = {shard: max(1, -(-support * (size or 0) // total)) for shard, size in sizes.items()}
    buckets_log2 = min(31, max(BUCKETS_LOG2, (total // BUCKET_BYTES).bit_length()))
    mined = dealt.mapInArrow(_mining(buckets_log2, min(support, 65535)), "bucket long, shard int, hashes binary, counts binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # All buckets of a block go to one task, which takes them one by one.
    buckets_of_block = max(0, _BLOCK_LOG2 - (SLOTS_LOG2 - buckets_log2))
    met = mined.repartition(parts, F.shiftright("bucket", buckets_of_block)).sortWithinPartitions("bucket")
    unite = _uniting(buckets_log2, supports)

    # Both steps in one call: two would take two Python workers for every task.
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(unite(batches))

    found = met.mapInArrow(blocks, "block long, bits binary").collect()
    return _united((r.block, bytes(r.bits)) for r in found)


def _dealt(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("lang"), text.alias("text"), F.pmod(F.xxhash64(text, F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
    )


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _spaced(piece: Piece, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words in lower case with one space after each, and where each byte went."""
    kept = _IN_WORDS[piece.data].astype(bool)
    kept[words.ends[words.ends < len(kept)]] = True
    data = _LOWER[piece.data[kept]]
    data[_IN_WORDS[data] == 0] = 0x20
    return data, np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])


class _Found:
    """Phrases of a task: their hashes, counts and places in the words kept of its texts."""

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.texts: list[np.ndarray] = []
        self.size = self.end = 0

    def add_text(self, data: np.ndarray) -> int:
        """Where the text begins among all that are kept."""
        self.texts.append(data)
        self.end += len(data)
        return self.end - len(data)

    def add(self, keys, times, lo, lengths, langs, size: int) -> None:
        numbers = [np.asarray(v, np.int32) for v in (times, lo, lengths, langs)]
        self.rows.append((keys, *numbers, np.full(len(keys), size, np.int8)))
        self.size += len(keys)

    def rows_of_counts(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Every phrase once with its count."""
        if not self.rows:
            return
        parts = [list(c) for c in zip(*self.rows)]
        self.rows.clear()
        # One column after the other, so that there are no two of the whole.
        keys, times, lo, lengths, langs, sizes = (np.concatenate(parts.pop(0)) for _ in range(len(parts)))
        data = np.concatenate(self.texts)
        self.texts.clear()
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        sums = np.add.reduceat(times[order], first, dtype=np.int64)
        one = order[first]
        for a in range(0, len(one), 8192):
            own = one[a : a + 8192]
            ends = np.concatenate([[0], np.cumsum(lengths[own], dtype=np.int64)])
            at = np.repeat(lo[own] - ends[:-1], lengths[own]) + np.arange(ends[-1])
            texts = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(ends), pa.py_buffer(data[at]))
            langs_of = pa.array(names, pa.string()).take(pa.array(langs[own]))
            yield _count_rows(langs_of, texts.cast(pa.string()), sizes[own].astype(np.int32), sums[a : a + 8192])


def _counting(table: np.ndarray, held: int) -> Callable:
    """A task's counts (lang, phrase, words, n) of phrases whose bit is set.

    The row of a language without a phrase has the number of all its words. About
    ``held`` places of phrases are in memory at most, besides those of one text.
    """
    shift = np.uint64(64 - SLOTS_LOG2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        found = _Found()
        for batch in batches:
            langs = ["und" if lang is None else lang for lang in batch.column("lang").to_pylist()]
            seeds = _seeds(langs)
            for lang in langs:
                totals.setdefault(lang, 0)
            names = list(totals)
            number = {name: i for i, name in enumerate(names)}
            numbers = np.array([number[lang] for lang in langs], np.int32)
            for piece in pieces(batch.column("text")):
                begin = moved = None
                for words, hashes, at, size in _phrases(piece, seeds[piece.lo : piece.hi]):
                    if size == 1:
                        for lang, n in zip(langs[piece.lo : piece.hi], words.counts().tolist()):
                            totals[lang] += n
                    slot = (hashes >> shift).astype(np.int64)
                    passed = np.flatnonzero((table[slot >> 3] << (slot & 7).astype(np.uint8)) & 128)
                    if not len(passed):
                        continue
                    if begin is None:
                        data, moved = _spaced(piece, words)
                        begin = found.add_text(data)
                    order = passed[np.argsort(hashes[passed], kind="stable")]
                    first = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
                    starts = at[order[first]]
                    lo, hi = moved[words.starts[starts]], moved[words.ends[starts + size - 1]]
                    owners = words.owners()[starts] + piece.lo
                    times = np.diff(np.append(first, len(order)))
                    found.add(hashes[order[first]], times, begin + lo, hi - lo, numbers[owners], size)
                if found.size >= held:
                    yield from found.rows_of_counts(names)
                    found = _Found()
        yield from found.rows_of_counts(list(totals))
        yield _count_rows(list(totals), pa.nulls(len(totals), pa.string()), [0] * len(totals), list(totals.values()))

    return count


def _count_rows(langs, phrases, sizes, times) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            langs if isinstance(langs, pa.Array) else pa.array(langs, pa.string()),
            phrases,
            pa.array(sizes, pa.int32()),
            pa.array(times, pa.int64()),
        ],
        names=["lang", "phrase", "words", "n"],
    )


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, held: int = HELD) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``n`` of all phrases found ``support`` times.

    A row with a null phrase has the number of all words of its language. Mines the
    shards when called, and writes the result to the shared folder.
    """
    table = locally_frequent(docs, support, shards)
    counted = _dealt(docs, shards).select("lang", "text").mapInArrow(
        _counting(table, held), "lang string, phrase string, words int, n long"
    )
    summed = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return settle(summed.filter((F.col("n") >= support) | F.col("phrase").isNull()), "phrases")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def _parts_inside() -> Column:
    """The shorter phrases of two words or more that lie in a phrase."""
    words = F.split("phrase", " ")
    parts = [
        F.when(F.col("words") >= start + size - 1, F.array_join(F.slice(words, start, size), " "))
        for size in range(2, LONGEST)
        for start in range(1, LONGEST - size + 2)
    ]
    return F.array_distinct(F.array_except(F.array(*parts), F.array(F.lit(None).cast("string"), F.col("phrase"))))


def scored(counts: DataFrame) -> DataFrame:
    """Candidates with the cut that scores lowest, without those inside a longer one.

    All parts of a candidate are as frequent as it is, so they are among ``counts``.
    """
    phrases = counts.filter(F.col("phrase").isNotNull())
    given = phrases.filter("words >= 2").withColumnRenamed("n", "a")
    cut = given.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    known = cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    exact = known.withColumns({"exact_a": _exact("a"), "parts": _exact("l") + _exact("r")})
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * exact_a) div parts").alias("score")
    least = exact.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut"))
    longer = given.select("lang", F.explode(_parts_inside()).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    inside = F.lit(100) * _exact("longer") >= F.lit(INSIDE_PERCENT) * _exact("a")
    return (
        least.join(most, ["lang", "phrase"], "left")
        .filter(~F.coalesce(inside, F.lit(False)))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )


def collocations(docs: DataFrame, support: int = SUPPORT, best: int = BEST, shards: int = SHARDS) -> DataFrame:
    """The ``best`` phrases of every language by score, count and text, with their rank.

    The best of each of many parts of a language are found first, so no task ranks
    all phrases of a language.
    """
    counts = frequent_phrases(docs, support, shards)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored(counts).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = first.filter(F.col("rank") <= best).drop("part", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = counts.filter(F.col("phrase").isNull()).select("lang", "n")
    return (
        ranked.filter(F.col("rank") <= best)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
