"""Exact Jaccard join of documents on their word shingles.

The documents are the rows and the shingles the columns of a sparse 0-1 matrix; its
product with its own transpose has the overlaps. Only entries that can reach the
threshold are worked out. Columns are ordered by how often they occur, as far as a
sketch of fixed size tells them from chance, and then by hash. In that order two linked documents share a column among their first quarter, and at the
first one that they share the rest of each must still hold the overlap that their
sizes ask for. The product runs column by column, for large columns in blocks of one
band of sizes. For what is left, overlaps are bounded by accumulating the smaller of two rows' counts over
``BLOCKS`` blocks of columns, and what survives that as well is counted column by column.

Equal sets are one row of the matrix. In columns of more than ``SMALL`` rows, the row
that comes first in its own order is paired with all others; what these links
connect need not be paired any more, so a large group of near copies costs a pair for
each member and not for each two.

Empty tables give empty results. Null, empty and blank texts have empty sets, linked
with nothing: their component is their own doc_id. Rows are judged by their texts, so
repeated rows share a component and keep a row each. A null doc_id is never the
smallest of a component. Other columns are ignored. Shingles are equal when their
64-bit hashes are; sets are told apart by two such hashes, and the job fails if one
agrees and the other does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from timelens.llm.components import connected
from timelens.llm.tables import discard, far, near, settle
from timelens.llm.words import BLANK_SEPARATED, Piece, gram_hashes, mix, pieces, run_hashes, split

SIZE = 5
#: Columns of more rows than this are joined through their first row before anything else.
SMALL = 30
#: Cells of the table that counts columns, and of the parts it is sent in. It is the
#: largest table that goes to all tasks, 8 MB.
CELLS, PART = 1 << 22, 1 << 12
#: Distinct sets that a task counts before it sends its table on; cells hold more.
COUNTED = 60_000
#: Columns counted so often are dealt out over several tasks.
OFTEN = 1000
#: Blocks of columns whose counts bound an overlap.
BLOCKS = 512
#: Members that are compared with one text at a time.
MEMBERS = 64
#: Sizes that can be linked are in the same band or the next.
BAND = 1.34


def shingle_sets(piece: Piece) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a piece."""
    words = split(piece.data, piece.offsets, BLANK_SEPARATED, fold=True)
    grams, _, first = gram_hashes(words, SIZE)
    sets = []
    for i, n in enumerate(words.counts()):
        if 0 < n < SIZE:
            sets.append(run_hashes(words.hashes, words.first[i : i + 1], words.first[i + 1 : i + 2]))
        else:
            sets.append(np.unique(grams[first[i] : first[i + 1]]))
    return sets


def _identity(values: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed numbers."""
    return (
        int(mix(values).sum(dtype=np.uint64).astype(np.int64)),
        int(mix(values + np.uint64(0x1F3D)).sum(dtype=np.uint64).astype(np.int64)),
    )


def _block_counts(values: np.ndarray) -> bytes:
    """How many columns of each block a set has; 255 stands for that many or more."""
    counts = np.bincount((values >> np.uint64(40)) % np.uint64(BLOCKS), minlength=BLOCKS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


class Sketch:
    """How often columns occur, about, in a table of fixed size.

    A column's count is at most its cell. The counts only order the columns: whatever
    the order, the same links are found.
    """

    def __init__(self, cells: np.ndarray | None = None) -> None:
        self.cells, self.noise = np.zeros(CELLS, np.uint16), 0
        if cells is not None:
            # What a cell holds by chance, and so much more that hardly any has it by chance.
            self.cells, load = cells, float(np.median(cells))
            self.noise = int(load + 6 * np.sqrt(load) + 1)

    @staticmethod
    def places(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(8)) & np.uint64(CELLS - 1)

    def add(self, values: np.ndarray) -> None:
        np.add.at(self.cells, self.places(values), 1)

    def counts(self, values: np.ndarray) -> np.ndarray:
        """The counts of columns that stand out from chance, 0 for all others."""
        found = self.cells[self.places(values)]
        return np.where(found > self.noise, found, 0)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every document, and the task's sketch of its distinct sets in blocks."""
    sketch, seen = Sketch(), set()
    schema = None

    def rows(own: pa.RecordBatch, n: list, one: list, two: list, blocks: list) -> pa.RecordBatch:
        numbers = [pa.array(v, pa.int64()) for v in (n, one, two)]
        none = pa.nulls(len(n), pa.int32())
        return pa.RecordBatch.from_arrays(
            [own.column("doc_id"), own.column("signature"), *numbers, pa.array(blocks, pa.binary()), none],
            schema=schema,
        )

    def parts_of(sketch: Sketch) -> pa.RecordBatch:
        # A task's counts stop at 255; the order of what is that frequent matters little.
        data = [part.tobytes() for part in np.minimum(sketch.cells, 255).astype(np.uint8).reshape(-1, PART)]
        nothing = [pa.nulls(len(data), field.type) for field in list(schema)[:5]]
        numbers = pa.array(np.arange(len(data), dtype=np.int32))
        return pa.RecordBatch.from_arrays([*nothing, pa.array(data, pa.binary()), numbers], schema=schema)

    for batch in batches:
        if schema is None:
            own = [pa.field(c, pa.int64()) for c in ("signature", "n", "fp", "again")]
            described = [pa.field("blocks", pa.binary()), pa.field("part", pa.int32())]
            schema = pa.schema([batch.schema.field("doc_id"), *own, *described])
        for piece in pieces(batch.column("text")):
            n, one, two, blocks = [], [], [], []
            for values in shingle_sets(piece):
                a, b = _identity(values)
                blocks.append(_block_counts(values))
                n.append(len(values))
                one.append(a)
                two.append(b)
                if len(values) and a not in seen:
                    seen.add(a)
                    sketch.add(values)
            if len(seen) >= COUNTED:
                yield parts_of(sketch)
                sketch, seen = Sketch(), set()
            yield rows(batch.slice(piece.lo, piece.hi - piece.lo), n, one, two, blocks)
    if schema is not None:
        yield parts_of(sketch)


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the tasks' parts of the sketch; equal parts come one after the other."""
    current, total = None, None

    def row() -> pa.RecordBatch:
        data = np.minimum(total, 65535).astype(np.uint16).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int32()), pa.array([data], pa.binary())], names=["part", "cells"]
        )

    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("blocks")):
            if part != current:
                if current is not None:
                    yield row()
                current, total = part, np.zeros(PART, np.int64)
            total += np.frombuffer(data.as_buffer(), np.uint8)
    if current is not None:
        yield row()


def whole_sketch(profile: DataFrame) -> Sketch:
    """The sketch of all documents; its size is fixed, and so is what the driver gets."""
    parts = int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = profile.filter("part is not null").select("part", "blocks")
    met = given.repartition(parts, "part").sortWithinPartitions("part")
    cells = np.zeros((CELLS // PART, PART), np.uint16)
    for row in met.mapInArrow(_add_parts, "part int, cells binary").collect():
        cells[row.part] = np.frombuffer(bytes(row.cells), np.uint16)
    return Sketch(cells.reshape(CELLS))


def prefix_length(n: int) -> int:
    """How many first columns of a set of ``n`` meet those of every set linked to it."""
    return n - (3 * n + 3) // 4 + 1


def _entries(sketch: Sketch):
    """The entries of the matrix that the join starts from: first columns of every set."""

    schema = pa.schema(
        [("gram", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("often", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in pieces(batch.column("text")):
                grams, fps, sizes, places, oftens = [], [], [], [], []
                for values in shingle_sets(piece):
                    n = len(values)
                    identity = _identity(values)[0]
                    if n == 0 or identity in seen:
                        continue
                    seen.add(identity)
                    times = sketch.counts(values)
                    order = np.argsort(times, kind="stable")[: prefix_length(n)]
                    grams.append(values[order])
                    oftens.append(times[order] >= OFTEN)
                    places.append(np.arange(len(order), dtype=np.int32))
                    fps.append(np.full(len(order), identity, np.int64))
                    sizes.append(np.full(len(order), n, np.int32))
                if grams:
                    yield pa.RecordBatch.from_arrays(
                        [
                            _signed(np.concatenate(grams)),
                            pa.array(np.concatenate(fps)),
                            pa.array(np.concatenate(sizes)),
                            pa.array(np.concatenate(places)),
                            pa.array(np.concatenate(oftens)),
                        ],
                        schema=schema,
                    )

    return run, "gram long, fp long, n int, place int, often boolean"


def _can_link(a: Column, p: Column, b: Column, q: Column) -> Column:
    """Sizes a and b fit, and after places p and q both still have the overlap that is needed."""
    needed = 3 * (a + b)
    return (
        (4 * F.least(a, b) >= 3 * F.greatest(a, b)) & (7 * (a - p) >= needed) & (7 * (b - q) >= needed)
    )


def shared_columns(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """What the columns that have two different rows or more lead to.

    Small columns: a row with the later rows (by size) that it may be linked to, in
    ``partners``; no further shuffle is needed for them. Other columns: all entries,
    with the column's number of rows ``m`` and its first row, the ``pivot``. The rows of
    frequent columns are dealt out over several tasks and summed up afterwards.
    """
    run, schema = _entries(sketch)
    entries = docs.select("text").mapInArrow(run, schema)
    share = F.when(F.col("often"), F.pmod(F.col("fp"), F.lit(64))).otherwise(0).alias("share")
    first = F.min(F.struct("place", "n", "fp"))
    column = Window.partitionBy("gram", "share")
    # Enough to hold the rest of a small column, and no more of a large one.
    later = column.orderBy("n", "fp").rowsBetween(1, SMALL)
    small = ~F.col("often") & (F.col("m") <= SMALL)

    def linkable(other: Column) -> Column:
        return _can_link(F.col("n"), F.col("place"), other["n"], other["place"]) & (other["fp"] != F.col("fp"))

    partners = F.transform(F.filter("later", linkable), lambda other: other["fp"])
    counted = (
        entries.select("*", share)
        .repartition("gram", "share")
        .distinct()
        .withColumn("m", F.count(F.lit(1)).over(column))
        .withColumn("pivot", first.over(column))
        .withColumn("later", F.collect_list(F.struct("fp", "n", "place")).over(later))
        .filter("often or m > 1")
        .withColumn("partners", F.when(small, partners))
        .filter("partners is null or size(partners) > 0")
        .drop("later")
    )
    counted = settle(counted, "columns")
    frequent_columns = (
        counted.filter("often").groupBy("gram").agg(F.count(F.lit(1)).alias("m"), first.alias("pivot"))
    )
    often = counted.filter("often").drop("m", "pivot").join(frequent_columns, "gram").filter("m > 1")
    return counted.filter("not often").unionByName(often).drop("often", "share")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a text and the members after it; a row without ``b`` is a text."""
    key, values = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = [], []
        for piece in pieces(batch.column("text")):
            for i, found in enumerate(shingle_sets(piece), piece.lo):
                if b[i] is None:
                    key, values = a[i], found
                    continue
                if key != a[i]:
                    raise ValueError("a text to compare with is missing")
                both = len(np.intersect1d(values, found, assume_unique=True))
                if 100 * both >= 75 * (len(values) + len(found) - both):
                    left.append(a[i])
                    right.append(b[i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
        )


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose accumulated bound reaches the overlap that their sizes ask for."""
    for batch in batches:
        n = batch.num_rows
        left, right = [
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, BLOCKS)
            for c in ("blocks", "other_blocks")
        ]
        bound = np.minimum(left, right).sum(axis=1, dtype=np.int64)
        needed = 3 * (batch.column("n").to_numpy() + batch.column("other_n").to_numpy())
        unknown = ((left == 255) & (right == 255)).any(axis=1)
        kept = batch.filter(pa.array((7 * bound >= needed) | unknown))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])


def within_bounds(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """The pairs that the counts by blocks of columns do not rule out."""
    left = ends.select(F.col("fp").alias("a"), "n", "blocks")
    right = ends.select(F.col("fp").alias("b"), F.col("n").alias("other_n"), F.col("blocks").alias("other_blocks"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "other_n", "blocks", "other_blocks")
    return rows.mapInArrow(_bounded, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``fp`` and the text of its ``doc_id`` and ``signature``, one row for each ``fp``.

    Rows that repeat a document are brought down to one of each task before the texts
    of a set are brought together.
    """
    signed = docs.select("doc_id", F.xxhash64("text").alias("signature"), "text")
    # Most copies of a text have another doc_id, so they are dropped where they are read.
    whole = F.xxhash64("doc_id", "signature").alias("whole")
    signed, chosen = signed.select("*", whole), chosen.select("*", whole)
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.signature") == F.col("c.signature"))
    same = (F.col("d.whole") == F.col("c.whole")) & same
    rows = near(signed, "whole", chosen).alias("d").join(chosen.alias("c"), same).select("c.fp", "d.text")
    texts = settle(rows.mapInArrow(_of_class, "fp long, text string"), "texts")
    return texts.groupBy("fp").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose whole sets meet the threshold.

    The text of one document of each class is fetched. A text goes once to every
    ``MEMBERS`` texts that it is compared with, so no text is a large group.
    """
    pairs = settle(pairs, "candidates")
    wanted = settle(_ends(pairs), "wanted")
    ends = settle(wanted.join(near(classes, "fp", wanted), "fp"), "ends")
    pairs = settle(within_bounds(pairs, ends), "pairs")
    chosen = settle(_ends(pairs).join(ends, "fp").select("fp", "first.doc_id", "first.signature"), "chosen")
    texts = texts_of(docs, chosen)
    degrees = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("chunks"))
    members = (
        pairs.join(degrees, "a")
        .withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")))
        .join(texts.withColumnRenamed("fp", "b"), "b")
        .select("a", "chunk", "b", "text")
    )
    centres = (
        degrees.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .join(texts.withColumnRenamed("fp", "a"), "a")
        .select("a", "chunk", F.lit(None).cast("long").alias("b"), "text")
    )
    rows = members.unionByName(centres).repartition("a", "chunk")
    rows = rows.sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return settle(rows.select("a", "b", "text").mapInArrow(_compare, "a long, b long").distinct(), "verified")


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each set that a task meets; its text must really have the set."""
    seen: set[int] = set()
    for batch in batches:
        new = {fp: i for i, fp in reversed(list(enumerate(batch.column("fp").to_pylist()))) if fp not in seen}
        seen.update(new)
        batch = batch.take(pa.array(sorted(new.values()), pa.int64()))
        wanted = batch.column("fp").to_pylist()
        for piece in pieces(batch.column("text")):
            for i, values in enumerate(shingle_sets(piece), piece.lo):
                if _identity(values)[0] != wanted[i]:
                    raise ValueError("two texts have one hash")
        yield batch


def _linked(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``signature`` (a hash of the text), ``n`` shingles and ``first`` of every document.

    ``first`` has the doc_id and signature of the component's first document: the one
    with the smallest doc_id, null being the largest, then the smallest signature. It is
    null for documents without shingles.
    """
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *[T.StructField(c, T.LongType()) for c in ("signature", "n", "fp", "again")],
            T.StructField("blocks", T.BinaryType()),
            T.StructField("part", T.IntegerType()),
        ]
    )
    signed = docs.select("doc_id", F.xxhash64("text").alias("signature"), "text")
    profile = settle(signed.mapInArrow(_profile, schema), "profile")
    described = profile.filter("part is null")
    rows = settle(described.select("doc_id", "signature", "n", "fp"), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "signature")
    same = (F.min("n") == F.max("n")) & (F.min("again") == F.max("again"))
    classes = settle(
        described.filter("n > 0")
        .groupBy("fp")
        .agg(
            F.min(first).alias("first"),
            F.first("blocks").alias("blocks"),
            F.when(same, F.min("n")).otherwise(
                F.raise_error(F.lit("two sets have one hash")).cast("long")
            ).alias("n"),
        ),
        "classes",
    )
    sketch = whole_sketch(profile)
    discard(profile)
    columns = settle(shared_columns(docs, sketch), "shared")

    small = columns.filter("partners is not null").select(F.col("fp").alias("a"), F.explode_outer("partners").alias("b"))
    columns = columns.filter("partners is null").drop("partners")
    reach = _can_link(F.col("n"), F.col("place"), F.col("pivot.n"), F.col("pivot.place"))
    stars = columns.filter((F.col("fp") != F.col("pivot.fp")) & reach)
    stars = stars.select(F.col("pivot.fp").alias("a"), F.col("fp").alias("b"))
    first_links = verify(small.unionByName(stars).distinct(), docs, classes)
    known = connected(first_links)

    # Rows of large columns that these links have not connected yet.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    placed = (
        columns.select("gram", "fp", "n", "place")
        .join(known, F.col("fp") == F.col("node"), "left")
        .select("gram", "fp", "n", "place", F.coalesce("component", "fp").alias("part"), band.alias("band"))
    )
    smaller = placed.filter("7 * place <= n")
    smaller = smaller.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("s")
    larger = placed.alias("l")
    in_order = (F.col("s.n") < F.col("l.n")) | (
        (F.col("s.n") == F.col("l.n")) & (F.col("s.fp") < F.col("l.fp"))
    )
    block = (F.col("s.gram") == F.col("l.gram")) & (F.col("s.band") == F.col("l.band"))
    reach = _can_link(F.col("s.n"), F.col("s.place"), F.col("l.n"), F.col("l.place"))
    rest = (
        smaller.join(larger, block & in_order & (F.col("s.part") != F.col("l.part")) & reach)
        .select(F.col("s.fp").alias("a"), F.col("l.fp").alias("b"))
        .distinct()
    )
    links = first_links.unionByName(verify(rest, docs, classes))
    parts = (
        classes.select("fp", "first")
        .join(connected(links), F.col("fp") == F.col("node"), "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    )
    parts = settle(parts, "parts")
    named = parts.groupBy("component").agg(F.min("first").alias("first"))
    of_class = parts.drop("first").join(named, "component").select(F.col("fp").alias("of"), "first")
    return rows.join(of_class, (F.col("fp") == F.col("of")) & (F.col("n") > 0), "left").select(
        "doc_id", "signature", "n", "first"
    )


def link_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Writes intermediate tables and runs jobs when called. What comes to the driver is
    the sketch, 8 MB.
    """
    return _linked(docs).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component: one of the smallest doc_id, a null one being the largest.

    A document is its doc_id and text, so another text of a dropped doc_id stays. Of the
    rows that repeat the kept document, the one with the smallest hash of all columns
    stays. Documents without shingles are linked with nothing and stay in all their rows.
    """
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("signature") == F.col("first.signature"))
    judged = (
        _linked(docs)
        .filter("n > 0")
        .groupBy("doc_id", F.col("signature").alias("_signature"))
        .agg(F.bool_or(own).alias("kept"), F.count(F.lit(1)).alias("rows"))
    )
    whole = F.xxhash64("doc_id", "_signature").alias("_whole")
    others = judged.filter("not kept or rows > 1").select("doc_id", "_signature", "kept", whole)
    others = settle(others, "others")
    same = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d._signature") == F.col("o._signature"))
    same = (F.col("d._whole") == F.col("o._whole")) & same
    # The row travels as one column, so its columns may have any names.
    columns = [F.col(c) for c in docs.columns]
    marked = docs.select("doc_id", F.xxhash64("text").alias("_signature"), F.struct(*columns).alias("_row"))
    marked = marked.select("*", whole)
    # Most documents are told apart from the others where they are read, and stay there.
    single = far(marked, "_whole", others).unionByName(
        near(marked, "_whole", others).alias("d").join(others.alias("o"), same, "left_anti")
    )
    # Repeated rows are brought down to one of each task before they are shuffled.
    again = others.filter("kept")
    repeated = (
        near(marked, "_whole", again)
        .groupBy("doc_id", "_signature", "_whole")
        .agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    )
    one = repeated.alias("d").join(again.alias("o"), same, "left_semi")
    return single.select("_row.*").unionByName(one.select("_row.*"))
