"""Mixing sources to target weights along a curriculum that changes with time.

A source's schedule gives its weight at equally spaced moments of the training and
is linear between them. Its integral is the source's weight in the whole mix; the
targets follow from the weights, held below ``MOST_REPEATS`` times the source. The
documents of a source stand in a fixed random order, its copies one after the other,
and each takes as much demand as it has words. Inverting the cumulative demand of
the schedule at a document's middle word gives its training position between 0 and
1; documents whose middle lies beyond the target are not taken.

Empty tables give empty results. A null text has no words; documents without words
take none. A null source is a source of its own, last in order. Rows alike in
doc_id, source and size are placed one after the other. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timelens.llm.tables import CHUNK, blank_words, key_text, near, numbered_copies, settle, unit_draw

#: Weights at the start, the middle and the end; sources take them in turn.
#: Their integrals are 5, 2 and 1.
SCHEDULES = ((6.0, 5.0, 4.0), (2.0, 2.0, 2.0), (0.5, 1.0, 1.5))
SHARE = 1.5
MOST_REPEATS = 2.0


def areas(schedule: Sequence[float]) -> list[float]:
    """Cumulative integral at the knots of a schedule over the time from 0 to 1."""
    width, found = 1.0 / (len(schedule) - 1), [0.0]
    for a, b in zip(schedule, schedule[1:]):
        found.append(found[-1] + (a + b) / 2 * width)
    return found


def moment(part: Column, schedule: Sequence[float]) -> Column:
    """The time by which ``part`` (0 to 1) of the schedule's demand has come."""
    cumulative = areas(schedule)
    width = 1.0 / (len(schedule) - 1)
    wanted = part * cumulative[-1]
    result = F.lit(1.0)
    for k in reversed(range(len(schedule) - 1)):
        a, b = schedule[k], schedule[k + 1]
        rest = F.greatest(wanted - cumulative[k], F.lit(0.0))
        if a == b:
            inside = rest / a if a else F.lit(0.0)
        else:  # a x + (b - a) x^2 / (2 width) = rest
            bend = (b - a) / width
            inside = 2 * rest / (a + F.sqrt(F.greatest(a * a + 2 * bend * rest, F.lit(0.0))))
            inside = F.when(rest > 0, inside).otherwise(0.0)
        result = F.when(wanted < cumulative[k + 1], k * width + inside).otherwise(result)
    return F.least(result, F.lit(1.0))


def source_targets(
    sizes: DataFrame,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    share: float = SHARE,
    most_repeats: float = MOST_REPEATS,
) -> DataFrame:
    """Target words of every source from ``source`` and ``source_size``.

    Sharing by weight and resharing what exceeds a cap until nothing does is filling
    all sources to one level per weight: in order of cap by weight, a source is full
    if the level that the later ones could share does not stay below it.

    All sources are ordered in one task, a narrow row for each. This is meant for few
    sources beside the documents; hosts or urls as sources give correct targets as well,
    but only as fast as one task sorts them.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(schedules)
    weights = F.array(*[F.lit(areas(s)[-1]) for s in schedules])
    weighed = (
        sizes.withColumn("turn", turn)
        .withColumn("weight", F.element_at(weights, (F.col("turn") + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(most_repeats))
    )
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = (
        by_level.rowsBetween(Window.unboundedPreceding, -1),
        by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing),
    )
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn(
            "full", F.col("cap") * F.col("open") <= (F.col("total") - F.col("filled")) * F.col("weight")
        )
    )
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    shared = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    level = (F.col("total") - taken) / F.nullif(shared, F.lit(0.0))
    target = F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))
    return levels.select("source", "source_size", "turn", target.alias("target"))


def _sizes(docs: DataFrame, *columns: Column) -> DataFrame:
    """Rows that are alike in ``doc_id``, ``source``, ``size`` and the columns, and how many."""
    size = F.size(blank_words(F.col("text"))).cast("bigint").alias("size")
    found = docs.select("doc_id", "source", size, *columns)
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("rows"))


def _starts(
    sizes: DataFrame, schedules: Sequence[Sequence[float]], share: float, most_repeats: float
) -> DataFrame:
    """Add ``start``, the words of the source before the row, and the source's target.

    ``sizes`` has a row for each doc_id, source and size. Sums run over slices of a source
    by hash, about the square root of all rows many, so a large source is no large group.
    """
    sized = settle(sizes.withColumn("draw", unit_draw(key_text(F.col("doc_id")))), "sizes")
    slices = max(1, math.isqrt(sized.count()))
    cut = sized.withColumn("slice", F.floor(F.col("draw") * slices).cast("int"))
    words = F.sum(F.col("size") * F.col("rows"))
    sums = cut.groupBy("source", "slice").agg(words.alias("words"))
    earlier = (
        Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    targets = source_targets(
        offsets.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, share, most_repeats
    ).withColumnRenamed("source", "of_source")
    offsets = offsets.withColumnRenamed("source", "of_source").withColumnRenamed("slice", "of_slice")
    known = offsets.alias("o").join(
        targets.alias("t"), F.col("o.of_source").eqNullSafe(F.col("t.of_source"))
    ).select("o.of_source", "of_slice", "offset", "source_size", "turn", "target")
    inside = (
        Window.partitionBy("source", "slice")
        .orderBy("draw", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = cut.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0))).join(
        known,
        F.col("source").eqNullSafe(F.col("of_source")) & (F.col("slice") == F.col("of_slice")),
    )
    start = (F.col("offset") + F.col("inside")).alias("start")
    return placed.select("doc_id", "source", "size", "rows", start, "source_size", "turn", "target")


def _positions(start: Column, schedules: Sequence[Sequence[float]], most_repeats: float) -> Column:
    """A time for each copy that the mix takes of the row that starts at the word ``start``."""
    copies = range(math.ceil(most_repeats))
    middles = [start + F.col("size") / 2.0 + F.col("source_size") * float(k) for k in copies]

    def position(middle: Column) -> Column:
        part = middle / F.nullif(F.col("target"), F.lit(0.0))
        by_turn = F.lit(1.0)
        for k, schedule in enumerate(schedules):
            by_turn = F.when(F.col("turn") == k, moment(part, schedule)).otherwise(by_turn)
        return F.when(middle < F.col("target"), by_turn)

    return F.array_compact(F.array(*[position(m) for m in middles]))


def place_documents(
    docs: DataFrame,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    share: float = SHARE,
    most_repeats: float = MOST_REPEATS,
) -> DataFrame:
    """Every document with its source's target and its training positions.

    ``positions`` holds a time for each copy that the mix takes. Writes a narrow
    intermediate table when called.
    """
    sizes = settle(_sizes(docs), "alike")
    placed = _starts(sizes, schedules, share, most_repeats)
    start = F.col("start") + F.col("row") * F.col("size")
    return numbered_copies(placed, sizes, "rows", "row", KEY).select(
        "doc_id", "source", "size", "source_size", "target",
        _positions(start, schedules, most_repeats).alias("positions"),
    )


def training_order(placed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, range-sorted by training position."""
    return (
        placed.withColumn("position", F.explode("positions"))
        .drop("positions")
        .repartitionByRange("position", "doc_id")
        .sortWithinPartitions("position", "doc_id")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of every document, in order of first training position."""
    rows = place_documents(docs).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("positions")).alias("taken"),
        F.round(F.try_element_at("positions", F.lit(1)), 9).alias("first_position"),
    )
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions(
        F.col("first_position").asc_nulls_last(), "doc_id"
    )


KEY = ["doc_id", "source", "size"]


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    pairs = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(and_, pairs)


def _numbered(groups: DataFrame, placed: DataFrame) -> DataFrame:
    """Where the first row of every group of equal rows starts.

    The groups of one doc_id, source and size follow each other by hash. They are
    summed up in slices, so many texts under one key are no large group.
    """
    groups = groups.filter("size > 0")
    slices = max(1, math.isqrt(groups.count()))
    cut = groups.withColumn("slice", F.pmod("alike", F.lit(slices)))
    before = Window.partitionBy(*KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*KEY, "slice")
        .agg(F.sum("rows").alias("rows"))
        .withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    )
    known = offsets.alias("o").join(placed.alias("p"), _same("o", "p", KEY))
    known = known.select("o.doc_id", "o.source", "o.size", "slice", "offset", "start", "source_size", "turn", "target")
    inside = Window.partitionBy(*KEY, "slice").orderBy("alike").rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("inside", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    start = F.col("start") + (F.col("offset") + F.col("inside")) * F.col("r.size")
    return rows.alias("r").join(known.alias("k"), _same("r", "k", [*KEY, "slice"])).select(
        "r.doc_id", "r.source", "r.size", "r.alike", "r.rows", start.alias("start"), "source_size", "turn", "target"
    )


def take_mix(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order.

    Every row has the positions that ``place_documents`` deals to a row of its doc_id,
    source and size; rows without words have none. Rows alike in all columns (by a
    64-bit hash) are fetched once and written as often as the mix takes them. Writes
    narrow intermediate tables when called.
    """
    alike = F.xxhash64(*[F.col(c) for c in docs.columns])
    groups = settle(_sizes(docs, alike.alias("alike")), "groups")
    placed = _starts(groups.groupBy(*KEY).agg(F.sum("rows").alias("rows")), SCHEDULES, SHARE, MOST_REPEATS)
    numbered = settle(_numbered(groups, placed), "numbered")
    size = F.size(blank_words(F.col("text"))).cast("bigint")
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "doc_id", "source", size.alias("size"), alike.alias("alike"))
    again = F.explode(_positions(F.col("start"), SCHEDULES, MOST_REPEATS)).alias("position")

    whole = [*KEY, "alike"]
    alone = numbered.filter("rows = 1").withColumn("positions", _positions(F.col("start"), SCHEDULES, MOST_REPEATS))
    alone = alone.filter(F.size("positions") > 0).select(*whole, "positions")
    once = marked.alias("d").join(alone.alias("n"), _same("d", "n", whole)).select(
        "row", F.explode("positions").alias("position")
    )
    # Equal rows are brought down to one of each task before they are shuffled.
    several = numbered.filter("rows > 1")
    texts = near(marked, "alike", several).groupBy(*whole).agg(F.first("row").alias("row"))
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rows") - 1) / CHUNK)))
    last = F.least(F.col("rows"), (F.col("chunk") + 1) * CHUNK) - 1
    repeated = (
        texts.alias("d").join(several.alias("n"), _same("d", "n", whole))
        .select("row", "n.size", "n.alike", "rows", "start", "source_size", "turn", "target", chunk.alias("chunk"))
        .repartition("alike", "chunk")
        .withColumn("number", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
        .withColumn("start", F.col("start") + F.col("number") * F.col("size"))
        .select("row", again)
    )
    return (
        once.unionByName(repeated)
        .repartitionByRange("position", "row.doc_id")
        .sortWithinPartitions("position", "row.doc_id")
        .select("row.*")
    )
