"""Prefix trie of conversations, by time-forward processing.

Every conversation is rebuilt with the first turns of another one; each distinct
sequence of first turns is a node. A node is named by its depth and by the sum of the
hashes of its turns and their places, 94 bits each, so names come from running totals
and no task needs a whole conversation.

Subtree totals go up by time-forward processing: nodes are sorted by reverse level
order, and a node sends its totals ahead, through a priority queue, to the place of its
parent. That happens within shards and then across shard roots:

* Subtrees with at most ``SHARD_ROWS`` turns below their top are shards of their own,
  dealt by the name of the top. However deep or wide a subtree is, no larger one is
  ever in one task.
* The nodes above them are cut into bands of ``BAND`` levels; a band is a shard with at
  most ``BAND * rows / SHARD_ROWS`` nodes. The tops of bands, a node for every ``BAND``
  of these, exchange their totals in one further pass, and the bands then run again
  with what came from below.

A queue spills sorted runs beyond ``HELD`` messages, to files of the task that have no
name and go with it, as the spills of Spark's sorts do.

Rows are ordered by turn, null first, then by the MD5 of role and text; null role and
text are empty; rows without conv_id belong to no conversation and are left out. Repeated
rows are turns of their own. Empty tables give no node, not even a root. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelens.llm.tables import settle

#: Conversations are rebuilt in groups of this many ids, with fewer than ``TURNS`` shared turns.
FAMILY, TURNS = 100, 6
SHARD_ROWS = 1 << 16
BAND = 64
#: Messages that a queue keeps in memory.
HELD = 1 << 17
#: Bytes of one part of a list of conversations.
PART_BYTES = 1 << 16

_NAME = "decimal(38,0)"


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _running(rows: DataFrame, order: list, value: str, name: str, what: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of a conversation.

    Rows are range-partitioned, so a long conversation spans many partitions, and
    written, so both steps see the same bounds. Each partition adds up its own rows;
    the totals of the partitions before it are a row per partition and conversation.
    """
    ranged = rows.repartitionByRange(_partitions(rows), "conv_id", *order)
    stored = settle(ranged.withColumn("part", F.spark_partition_id()), what)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("conv_id", "part").agg(F.sum(value).alias("total"))
    offsets = totals.select("conv_id", "part", F.sum("total").over(earlier).alias("offset"))
    before = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumn("inside", F.sum(value).over(before))
    zero = F.lit(0).cast(stored.schema[value].dataType)
    total = F.coalesce("offset", zero) + F.coalesce("inside", zero)
    return local.join(offsets, ["conv_id", "part"]).withColumn(name, total).drop("part", "offset", "inside")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 0), ``digest`` of role and text, ``tokens``, in the shared folder."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.length(text).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("one"),
        # Tells repeated rows apart, so that a range can end between them.
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("turn"), F.asc("digest"), F.asc("row")]
    placed = _running(turns, order, "one", "place", "turns")
    return settle(placed.select("conv_id", "place", "digest", "tokens"), "places")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, place, digest, tokens, turns) and conversations (conv_id, turns).

    ``turns`` counts the turns of the rebuilt conversation. The shared first turns are
    fewer than ``TURNS`` rows for each of the ``FAMILY`` ids.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % TURNS).cast("long")
    known = own.withColumns({"source": F.col("conv_id") - F.col("conv_id") % FAMILY, "wanted": shared})
    sources = own.select(F.col("conv_id").alias("source"), F.col("own").alias("there"))
    taken = F.least("wanted", F.coalesce("there", F.lit(0).cast("long")))
    rest = F.greatest(F.col("own") - F.col("wanted"), F.lit(0).cast("long"))
    known = (
        known.join(sources, "source", "left")
        .withColumn("taken", taken)
        .withColumn("turns", F.col("taken") + rest)
        .select("conv_id", "source", "wanted", "taken", "turns")
    )
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < TURNS - 1))
    heads = heads.withColumnRenamed("conv_id", "source")
    given = known.join(heads, "source").filter("place < taken")
    kept = turns.join(known, "conv_id").filter("place >= wanted").withColumn("place", F.expr("taken + place - wanted"))
    columns = ["conv_id", "place", "digest", "tokens", "turns"]
    return given.select(*columns).unionByName(kept.select(*columns)), known.select("conv_id", "turns")


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row for every node on the path of every rebuilt conversation, the root included.

    ``conv_id``, ``depth``, ``name``, ``parent`` (its name), ``tokens`` of the last
    turn and ``rest``, the turns that follow; in the shared folder.
    """
    rebuilt, known = rebuilt_turns(ordered_turns(conversations))
    high = F.shiftrightunsigned(F.xxhash64("place", "digest"), 1).cast("decimal(19,0)")
    low = F.shiftrightunsigned(F.xxhash64("digest", "place"), 33).cast("decimal(10,0)")
    valued = rebuilt.withColumn("value", (high * F.lit(1 << 31) + low).cast("decimal(29,0)").cast(_NAME))
    summed = _running(valued, [F.asc("place")], "value", "before", "prefixes")
    nodes = summed.select(
        "conv_id",
        (F.col("place") + 1).alias("depth"),
        (F.col("before") + F.col("value")).cast(_NAME).cast("string").alias("name"),
        F.col("before").cast(_NAME).cast("string").alias("parent"),
        "tokens",
        (F.col("turns") - F.col("place") - 1).alias("rest"),
    )
    zero = F.lit(0).cast("long")
    roots = known.select(
        "conv_id",
        zero.alias("depth"),
        F.lit("0").alias("name"),
        F.lit(None).cast("string").alias("parent"),
        zero.alias("tokens"),
        F.col("turns").alias("rest"),
    )
    return settle(nodes.unionByName(roots), "paths")


class SpillingQueue:
    """Messages by key, smallest key first; sorted runs go to files beyond ``held`` messages."""

    def __init__(self, held: int = HELD) -> None:
        self.held = held
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # the smallest message of every run, with the run
        self.runs = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            run = tempfile.TemporaryFile()
            for row in sorted(self.heap):
                pickle.dump(row, run)
            run.seek(0)
            self.heap = []
            self.runs += 1
            self._advance(self.runs, run)

    def _advance(self, number: int, run) -> None:
        try:
            heapq.heappush(self.heads, (pickle.load(run), number, run))
        except EOFError:
            run.close()

    def pop(self, key: tuple) -> Iterator[tuple]:
        """All messages whose first fields are the key; none smaller may be waiting."""
        while self.heads and self.heads[0][0][: len(key)] == key:
            message, number, run = heapq.heappop(self.heads)
            self._advance(number, run)
            yield message
        while self.heap and self.heap[0][: len(key)] == key:
            yield heapq.heappop(self.heap)

    def __len__(self) -> int:
        return len(self.heap) + len(self.heads)


TOTALS = "shard string, depth long, name string, parent string, top boolean, children long, leaves long, saved long"
_TOTALS = pa.schema(
    [
        ("shard", pa.string()),
        ("depth", pa.int64()),
        ("name", pa.string()),
        ("parent", pa.string()),
        ("top", pa.bool_()),
        ("children", pa.int64()),
        ("leaves", pa.int64()),
        ("saved", pa.int64()),
    ]
)


def _forward(held: int) -> Callable:
    """Totals of all nodes; rows come by shard in reverse level order.

    A row brings its own counts and what came from other shards; to these are added
    the messages of its children. The top of a shard sends no message.
    """

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, current = SpillingQueue(held), None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in _TOTALS.names)))
            out = []
            for shard, depth, name, parent, top, children, leaves, saved in rows:
                if shard != current:
                    if len(queue):
                        raise ValueError(f"nodes of shard {current} wait for a parent that is not there")
                    current = shard
                for message in queue.pop((-depth, name)):
                    children += 1
                    leaves += message[2]
                    saved += message[3]
                if not top:
                    queue.push((1 - depth, parent, leaves, saved))
                out.append((shard, depth, name, parent, top, children, leaves, saved))
            columns = list(zip(*out)) or [[]] * len(_TOTALS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _TOTALS.types)], schema=_TOTALS
            )
        if len(queue):
            raise ValueError(f"nodes of shard {current} wait for a parent that is not there")

    return forward


def time_forward(nodes: DataFrame, held: int = HELD) -> DataFrame:
    """Subtree totals within every shard of ``nodes``, a table with the columns of ``TOTALS``."""
    sent = nodes.select(*_TOTALS.names).repartition(_partitions(nodes), "shard")
    ordered = sent.sortWithinPartitions("shard", F.desc("depth"), "name")
    return ordered.mapInArrow(_forward(held), TOTALS)


def _received(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes with the totals of children in other shards added."""
    own = messages.select(
        (F.col("depth") - 1).alias("depth"), F.col("parent").alias("name"), F.col("leaves").alias("l"), F.col("saved").alias("s")
    )
    summed = own.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s"))
    zero = F.lit(0).cast("long")
    added = {
        to: F.col(to) + F.coalesce(F.col(of), zero) for to, of in (("children", "c"), ("leaves", "l"), ("saved", "s"))
    }
    return nodes.join(summed, ["depth", "name"], "left").withColumns(added).drop("c", "l", "s")


def subtree_totals(paths: DataFrame, nodes: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND, held: int = HELD) -> DataFrame:
    """``depth``, ``name``, ``parent``, ``children``, ``leaves`` and ``saved`` of every node."""
    zero = F.lit(0).cast("long")
    own = nodes.withColumns(
        {
            "children": zero,
            "leaves": (F.col("below") == 0).cast("long"),
            "saved": (F.col("n_convs") - 1) * F.col("tokens"),
        }
    )
    upper, lower = own.filter(F.col("below") > shard_rows), own.filter(F.col("below") <= shard_rows)

    # Shards of their own: every node goes to the highest such node of its path.
    inside = paths.join(upper.select("depth", "name"), ["depth", "name"], "left_anti")
    tops = inside.groupBy("conv_id").agg(F.min(F.struct("depth", "name")).alias("at"))
    dealt = lower.join(tops, "conv_id").withColumns(
        {"shard": F.concat_ws("/", "at.depth", "at.name"), "top": F.col("depth") == F.col("at.depth")}
    )
    small = settle(time_forward(dealt, held), "shards")

    # The nodes above them, by bands of levels.
    level = F.floor(F.col("depth") / band)
    banded = upper.withColumns({"shard": level.cast("string"), "top": F.col("depth") % band == 0})
    fed = settle(_received(banded, small.filter("top AND depth > 0")), "bands")
    first = time_forward(fed, held).filter("top").select("depth", "name", "leaves", "saved")

    # The tops of bands: each sends its totals to the top of the band above it.
    marks = paths.filter(F.col("depth") % band == 0).select(
        "conv_id", (F.col("depth") + band).alias("depth"), F.col("name").alias("above")
    )
    linked = first.join(nodes.select("depth", "name", "conv_id"), ["depth", "name"])
    linked = linked.join(marks, ["conv_id", "depth"], "left")
    across = linked.select(
        F.lit("").alias("shard"),
        (F.col("depth") / band).cast("long").alias("depth"),
        "name",
        F.col("above").alias("parent"),
        (F.col("depth") == 0).alias("top"),
        zero.alias("children"),
        "leaves",
        "saved",
    )
    whole = time_forward(across, held).select((F.col("depth") * band).alias("depth"), "name", "leaves", "saved")
    below = whole.filter("depth > 0").join(fed.select("depth", "name", "parent"), ["depth", "name"])
    large = time_forward(_received(fed, below), held)
    return small.unionByName(large).select("depth", "name", "parent", "children", "leaves", "saved")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a node, which come in order, as parts of text with their first id."""
    current, ids, size = None, [], 0
    out: list[tuple] = []

    def close() -> None:
        out.append((*current, ids[0], ",".join(map(str, ids))))

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["depth", "name", "first", "ids"])
        out.clear()
        return made

    for batch in batches:
        for depth, name, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "conv_id"))):
            if current is not None and (current != (depth, name) or size >= PART_BYTES):
                close()
                ids, size = [], 0
            current = (depth, name)
            ids.append(conv)
            size += 8
        yield rows()
    if current is not None:
        close()
    yield rows()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's parts, which come in order, one part in memory at a time."""
    current, digest = None, None

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [[]] * 3
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["depth", "name", "ends"])

    for batch in batches:
        found = []
        for depth, name, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "ids"))):
            if current == (depth, name):
                digest.update(b",")
            else:
                if current is not None:
                    found.append((*current, digest.hexdigest()))
                current, digest = (depth, name), hashlib.sha256()
            digest.update(ids.encode())
        yield rows(found)
    if current is not None:
        yield rows([(*current, digest.hexdigest())])


def ends(paths: DataFrame) -> DataFrame:
    """``depth``, ``name`` and ``ends``: SHA-256 of the conversations that end at a node.

    Ids are sorted by range, so those of one node may lie in many partitions; each
    writes its part as text, and only these parts meet.
    """
    n = _partitions(paths)
    order = ["depth", "name", "conv_id"]
    last = paths.filter("rest = 0").select(*order)
    parts = last.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _parts, "depth long, name string, first long, ids string"
    )
    met = parts.repartition(n, "depth", "name").sortWithinPartitions("depth", "name", "first")
    return met.mapInArrow(_digests, "depth long, name string, ends string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND, held: int = HELD) -> DataFrame:
    """A row for every node of the trie of rebuilt conversations.

    ``conv_id``: its smallest member; ``depth``; ``parent_conv_id``; ``n_convs``, its
    members; ``n_children``; ``n_leaves`` and ``saved_tokens`` of its subtree;
    ``ends_sha256`` of the members that end there. Writes intermediate tables when called.
    """
    paths = prefixes(conversations)
    nodes = settle(
        paths.groupBy("depth", "name").agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.max("parent").alias("parent"),
            F.max("tokens").alias("tokens"),
            F.sum("rest").alias("below"),
        ),
        "nodes",
    )
    totals = subtree_totals(paths, nodes, shard_rows, band, held).drop("parent")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(above, ["depth", "parent"], "left")
        .join(totals, ["depth", "name"])
        .join(ends(paths), ["depth", "name"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
        )
    )
