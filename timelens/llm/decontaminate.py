"""Benchmark decontamination by winnowing.

Texts are cut into words and runs of ``GRAM`` words hashed. Of every ``WINDOW -
GRAM + 1`` consecutive hashes the smallest is kept, so two texts that share
``WINDOW`` words share a kept hash, whatever stands around them. Documents and
benchmark are joined on kept hashes. In the documents that meet, whole windows that
the benchmark has are placed on diagonals (document place less item place), and
windows at consecutive places extend a hit to one span. Items of fewer words are one
window each and are joined by the hash of the whole item.

Empty tables, null and empty texts have no words, no items and no hits. Null item ids
count as the empty text; items repeated under one id count once. A document is its
doc_id and text: rows alike in both get the same result. Other columns are ignored.
Equality of runs is equality of chained 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timelens.llm.grams import add_runs, joined, smaller, word_hashes
from timelens.llm.tables import alphanumeric_words, key_text, settle

WINDOW = 13
GRAM = 6
#: A document is contaminated if at least one word in this many is hit.
ONE_IN = 20

DOCUMENT = ["doc_id", "signature"]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("signature"), "text")


def _same_document(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.signature") == F.col(f"{right}.signature")
    )


def _hashed(rows: DataFrame) -> DataFrame:
    """``text`` replaced by ``h1``, the hashes of its words."""
    return rows.withColumn("h1", word_hashes(alphanumeric_words(F.col("text")))).drop("text")


def _winnowed(rows: DataFrame) -> DataFrame:
    """Add ``kept``: the winnowed hashes of every text, each once."""
    rows = add_runs(rows, GRAM, joined, "h").withColumn("m1", F.col(f"h{GRAM}"))
    rows = add_runs(rows, WINDOW - GRAM + 1, smaller, "m")
    return rows.withColumn("kept", F.array_distinct(f"m{WINDOW - GRAM + 1}"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Items that have words: ``item``, ``n`` words, their hashes, and one for the text."""
    items = _hashed(benchmark.select(key_text(F.col("item_id")).alias("item"), "text"))
    return (
        items.withColumn("n", F.size("h1"))
        .filter("n > 0")
        .withColumn("wording", F.xxhash64("h1"))
        .dropDuplicates(["item", "wording"])
    )


def _with_places(n: int) -> Column:
    def entry(h: Column, i: Column) -> Column:
        return F.struct(F.lit(n).alias("size"), i.alias("place"), h.alias("hash"))

    return F.transform(f"h{n}", entry)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Word count and winnowed hashes of every document."""
    return _winnowed(_hashed(_identified(docs))).select(
        *DOCUMENT, F.size("h1").cast("bigint").alias("n_words"), "kept"
    )


def _meeting(rows: DataFrame, hashes: Column, prints: DataFrame) -> DataFrame:
    """Documents with a hash that the benchmark has too.

    The generator is an outer one, whose nulls the join drops: from an inner one the
    optimizer derives a test for emptiness that repeats all steps before it.
    """
    exploded = rows.select(*DOCUMENT, F.explode_outer(hashes).alias("hash"))
    return exploded.join(prints, "hash", "left_semi").select(*DOCUMENT)


def hit_spans(docs: DataFrame, kept: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, signature, item, lo, hi): places of words inside occurring windows.

    Reads the few distinct word counts below ``WINDOW`` of the items and writes
    intermediate tables when called.
    """
    items = settle(benchmark_items(benchmark), "items")
    lengths = sorted(r.n for r in items.filter(F.col("n") < WINDOW).select("n").distinct().collect())
    long_items = items.filter(F.col("n") >= WINDOW)
    prints = _winnowed(long_items).select(F.explode_outer("kept").alias("hash")).distinct()
    runs = add_runs(long_items, WINDOW, joined, "h").select(
        "item", "wording", "n", F.lit(WINDOW).alias("size"), F.posexplode_outer(f"h{WINDOW}").alias("item_place", "hash")
    )
    for n in lengths:
        whole = add_runs(items.filter(F.col("n") == n), n, joined, "h").select(
            "item", "wording", "n", F.col("n").alias("size"), F.lit(0).alias("item_place"), F.col(f"h{n}")[0].alias("hash")
        )
        runs = runs.unionByName(whole)
    runs = settle(runs, "runs")
    met = _meeting(kept, F.col("kept"), settle(prints, "prints"))
    if lengths:
        whole = runs.filter(F.col("n") < WINDOW).select("hash").distinct()
        searched = _hashed(_identified(docs))
        for n in lengths:
            searched = add_runs(searched, n, joined, "h")
        sought = F.concat(*[F.array_distinct(f"h{n}") for n in lengths])
        met = met.unionByName(_meeting(searched, sought, settle(whole, "wholes")))
    met = settle(met.distinct(), "met")

    # Only documents that share a kept hash are looked at place by place. Whole windows
    # are compared there: documents and items that share a shorter run meet nowhere.
    near = _identified(docs).alias("d").join(met.alias("m"), _same_document("d", "m"), "left_semi")
    near = _hashed(near)
    for n in {WINDOW, *lengths}:
        near = add_runs(near, n, joined, "h")
    placed = F.concat(*[_with_places(n) for n in sorted({WINDOW, *lengths})])
    matched = (
        near.select(*DOCUMENT, F.explode_outer(placed).alias("run"))
        .select(*DOCUMENT, "run.*")
        .join(runs, ["hash", "size"])
        .select(*DOCUMENT, "place", "item", "wording", "n", "size", "item_place")
    )
    short = matched.filter(F.col("n") < WINDOW).select(
        *DOCUMENT, "item", F.col("place").alias("lo"), (F.col("place") + F.col("n") - 1).alias("hi")
    )
    diagonal = [*DOCUMENT, "item", "wording", "diagonal"]
    along = Window.partitionBy(*diagonal).orderBy("place")
    long = (
        matched.filter(F.col("n") >= WINDOW)
        .withColumn("diagonal", F.col("place") - F.col("item_place"))
        .withColumn("island", F.col("place") - F.dense_rank().over(along))
        .groupBy(*diagonal, "island")
        .agg(F.min("place").alias("lo"), (F.max("place") + WINDOW - 1).alias("hi"))
        .select(*DOCUMENT, "item", "lo", "hi")
    )
    return long.unionByName(short) if lengths else long


def judge_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words, hit words, items and verdict of every document, with its signature."""
    kept = settle(fingerprints(docs), "kept")
    spans = settle(hit_spans(docs, kept, benchmark).distinct(), "spans")
    items = spans.groupBy(*DOCUMENT).agg(F.array_sort(F.collect_set("item")).alias("items"))
    words = (
        spans.select(*DOCUMENT, "lo", "hi")
        .distinct()
        .select(*DOCUMENT, F.explode(F.sequence("lo", "hi")).alias("place"))
        .distinct()
        .groupBy(*DOCUMENT)
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    hit = items.alias("i").join(words.alias("w"), _same_document("i", "w")).select("i.*", "w.n_hit")
    n_hit = F.coalesce(F.col("h.n_hit"), F.lit(0).cast("bigint"))
    found = F.coalesce(F.col("h.items"), F.array().cast("array<string>"))
    return (
        kept.alias("d")
        .join(settle(hit, "hit").alias("h"), _same_document("d", "h"), "left")
        .select(
            "d.doc_id",
            "d.signature",
            "d.n_words",
            n_hit.alias("n_hit"),
            F.size(found).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (ONE_IN * n_hit >= F.col("d.n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    bad = judge_contamination(docs, benchmark).filter("contaminated").select(*DOCUMENT).distinct()
    # The row travels as one column, so its columns may have any names.
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = docs.select("doc_id", F.xxhash64("text").alias("signature"), row).alias("d")
    bad = settle(bad, "contaminated").alias("b")
    return rows.join(bad, _same_document("d", "b"), "left_anti").select("_row.*")
