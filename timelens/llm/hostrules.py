"""Quality rules for single documents and, from their failures, for whole hosts.

A document fails by itself if it is short or repeats itself. The failures of every
host (the ``source`` of a document) are added up, its failure rate is shrunk towards
the rates of all hosts with a beta prior fitted to them by moments, and documents of
hosts whose shrunk rate stays above ``MOST_FAILING`` are dropped as well.

Empty tables give empty results. A null or blank text has no words and fails. A null
source is a host of its own. Repeated rows are documents of their own and count as
such. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.llm.grams import joined, word_hashes
from timelens.llm.tables import BLANK_CHARACTERS, blank_words, settle

LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: A host whose shrunk failure rate is above this loses all its documents.
MOST_FAILING = 0.5
#: Documents that the prior counts for where the hosts do not differ at all.
EQUAL_HOSTS_PRIOR = 100.0


def covered_words(placed: Column) -> Column:
    """Words inside windows that occur twice or more.

    ``placed`` has (hash, place) of every window, sorted. The places whose hash a
    neighbour has are sorted again; each covers the words that no earlier one does.
    """
    last = F.size(placed) - 1
    repeated = F.filter(
        placed,
        lambda x, i: ((i > 0) & (F.get(placed, i - 1)["h"] == x["h"]))
        | ((i < last) & (F.get(placed, i + 1)["h"] == x["h"])),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-REPEAT_WINDOW).alias("before"))
    return F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["i"])),
        start,
        lambda found, i: F.struct(
            (found["n"] + F.least(F.lit(REPEAT_WINDOW), i - found["before"])).alias("n"),
            i.alias("before"),
        ),
        lambda found: found["n"],
    )


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and the measures of every document."""
    text, blank = F.coalesce(F.col("text"), F.lit("")), F.lit(BLANK_CHARACTERS)
    lines = F.filter(F.split("body", "\n"), lambda line: F.btrim(line, blank) != "")
    # A projection for each step, so that no later step repeats an earlier one.
    rows = docs.select("doc_id", "source", text.alias("body")).select(
        "doc_id",
        "source",
        F.regexp_count("body", F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        lines.alias("lines"),
        blank_words(F.col("body")).alias("words"),
    )
    rows = rows.withColumn("word_chars", F.length(F.array_join("words", "")))
    rows = rows.withColumn("h1", word_hashes(F.col("words"))).drop("words")
    rows = rows.withColumn("h2", joined(F.col("h1"), F.col("h1"), 1))
    rows = rows.withColumn("h4", joined(F.col("h2"), F.col("h2"), 2))
    rows = rows.withColumn("h8", joined(F.col("h4"), F.col("h4"), 4))
    placed = F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size("h8") > F.size(F.array_distinct("h8"))
    rows = rows.withColumn("placed", F.when(repeats, placed))
    return rows.select(
        "doc_id",
        "source",
        F.size("h1").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        F.col("n_symbols").cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("placed").isNotNull(), covered_words(F.col("placed")))
        .otherwise(0)
        .cast("bigint")
        .alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def host_verdicts(judged: DataFrame, most_failing: float = MOST_FAILING) -> DataFrame:
    """Failures, shrunk failure rate and verdict of every host.

    With the mean m and variance v of the hosts' rates the prior weighs as many
    documents as ``m (1 - m) / v - 1``, one at least.
    """
    hosts = judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")
    )
    rate = F.col("failed") / F.col("docs")
    spread = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("variance"))
    odds = F.col("mean") * (1 - F.col("mean")) / F.nullif(F.col("variance"), F.lit(0.0)) - 1
    prior = spread.select(
        "mean", F.coalesce(F.greatest(odds, F.lit(1.0)), F.lit(EQUAL_HOSTS_PRIOR)).alias("strength")
    )
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (
        F.col("docs") + F.col("strength")
    )
    # The prior is one row.
    rated = hosts.crossJoin(prior).withColumn("host_rate", shrunk)
    return rated.select(
        "source", "docs", "failed", "host_rate", (F.col("host_rate") > most_failing).alias("host_failed")
    )


def judge_documents(docs: DataFrame, most_failing: float = MOST_FAILING) -> DataFrame:
    """Measures and verdict of every document.

    The measures are written as a narrow table when called, because both the host
    rates and the result need them.
    """
    judged = settle(measures(docs).withColumn("base_failed", base_failed()), "measures")
    hosts = settle(host_verdicts(judged, most_failing), "hosts")
    verdicts = hosts.select(F.col("source").alias("host"), "host_failed")
    return judged.join(verdicts, F.col("source").eqNullSafe(F.col("host")), "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )
