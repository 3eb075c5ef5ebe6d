"""WARC archives of pages, compressed record by record with a Zstandard dictionary.

Pages are dealt over archives. Each archive's dictionary is built from its first
records (``SAMPLE`` bytes of them at most); it stands in a skippable frame at the
start, itself compressed, and every record is a frame of its own, so a reader can
start at any record once it has the dictionary. Pages with equal payloads are archived
once: the largest page_id is the response, the others are revisits that refer to it.

An archive is written under a name of its own try and then renamed, so a task that
runs again leaves no half archive behind; the list of archives names the tries that
counted. Paths may be in any file system that Arrow can open.

Empty tables give no archives and empty results. Null payloads are empty ones, null
urls empty texts. Rows that share page_id and payload are archived each, as responses
if theirs is the largest page_id of the payload, else as revisits. A null page_id is
smaller than all others; it is written as an empty one and read back as null. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm.tables import settle

#: Bytes of payloads, urls and headers that one archive is meant to hold.
ARCHIVE = 16_000_000
#: Bytes of a record besides its payload and url, about.
HEADER = 400
#: Tasks that archives are read in, at most.
MOST_TASKS = 20_000
#: Bytes of records that a dictionary is built from, and its own size.
SAMPLE, DICTIONARY = 2_000_000, 65_536
LEVEL = 3
# Fixed values of the format: the frame that holds the dictionary, the version line.
SKIPPABLE_FRAME = 0x184D2A5D
VERSION = "WARC/1.1"
#: One date for all records, so that archives of the same pages are the same.
DATE = "2000-01-01T00:00:00Z"
#: Payloads below this size are never revisits.
LEAST_REVISIT = 0

ROLES = "page_id long, url string, html string, digest binary, record_type string, refers_to long"


def base32_digest(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id, url: str, payload: bytes, digest: bytes, kind: str, refers_to) -> bytes:
    """One WARC record; revisits carry no payload, only its digest and size."""
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        # Line breaks would end the header.
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{base32_digest(digest)}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if kind == "revisit":
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError(f"no record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    payload = rest[: int(fields["Content-Length"])]
    if len(payload) != int(fields["Content-Length"]) or rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError("a record does not have its length")
    return fields, payload


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from the records; their last bytes themselves if they are too few to train."""
    if len(records) >= 8:
        try:
            return zstandard.train_dictionary(DICTIONARY, records).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-DICTIONARY:] or VERSION.encode()


def _compressor(trained: bytes) -> zstandard.ZstdCompressor:
    # Frames name their content's size and carry a checksum.
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True
    )


class ArchiveWriter:
    """Writes records to one archive; nothing is seen under ``path`` before ``close``."""

    def __init__(self, path: str) -> None:
        self.system, self.path = fs.FileSystem.from_uri(path)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.trial = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.system.open_output_stream(self.trial, compression=None)
        self.waiting: list[bytes] = []
        self.size, self.records, self.compress = 0, 0, None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compress is not None:
            self.out.write(self.compress(data))
            return
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= SAMPLE:
            self._start()

    def _start(self) -> None:
        trained = dictionary(self.waiting)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
        self.out.write(struct.pack("<II", SKIPPABLE_FRAME, len(packed)) + packed)
        self.compress = _compressor(trained).compress
        for data in self.waiting:
            self.out.write(self.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.compress is None:
            self._start()
        self.out.close()
        self.system.move(self.trial, self.path)


def read_archive(path: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_FRAME:
            raise ValueError(f"{path} has no dictionary")
        trained = zstandard.ZstdDecompressor().decompress(source.read(size))
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
        frame, found, buffer = reader.decompressobj(), [], b""
        while True:
            if not buffer:
                buffer = source.read(step)
                if not buffer:
                    break
            found.append(frame.decompress(buffer))
            buffer = b""
            if frame.eof:
                yield b"".join(found)
                buffer, found = frame.unused_data, []
                frame = reader.decompressobj()
        if any(found):
            raise ValueError(f"{path} ends inside a record")


def _revisits(pages: DataFrame, least: int) -> DataFrame:
    """Every page with its payload's digest and the page that its payload is archived with.

    A null page_id is no largest one: such a page revisits any page with an id. Where no
    page of a payload has an id, and where the largest id has several rows, each of
    these is a response.
    """
    payload = F.coalesce("html", F.lit(""))
    hashed = pages.select(
        "page_id",
        F.monotonically_increasing_id().alias("row"),
        F.coalesce("url", F.lit("")).alias("url"),
        payload.alias("html"),
        F.unhex(F.sha1(payload)).alias("digest"),
        F.octet_length(payload).alias("size"),
    )
    # A digest's group is summed up before it is shuffled, whatever its size.
    firsts = settle(
        hashed.filter(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("pages"))
        .filter("pages > 1")
        .select(F.col("digest").alias("of"), F.col("size").alias("of_size"), "response"),
        "responses",
    )
    same = (F.col("digest") == F.col("of")) & (F.col("size") == F.col("of_size"))
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return hashed.join(firsts, same, "left").select(
        "page_id",
        "row",
        "url",
        "html",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("response")).alias("refers_to"),
        "size",
    )


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Archive all pages below ``path``; returns the path and records of every archive.

    Writes when called. Rows are dealt by a hash of their number, so archives are about
    equally large, whatever pages are empty or repeated. Headers count like payloads.
    """
    none = F.lit(0)
    record_bytes = HEADER + F.coalesce(F.octet_length("url"), none) + F.coalesce(F.octet_length("html"), none)
    total = pages.agg(F.sum(record_bytes)).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    rows = _revisits(pages, least_revisit)
    dealt = F.pmod(F.xxhash64("page_id", "row", F.lit("archive")), F.lit(archives))
    rows = rows.withColumn("archive", dealt).repartition("archive").sortWithinPartitions("archive", "page_id")
    columns = ["archive", "page_id", "url", "html", "digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, current = None, None

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([writer.records], pa.int64())], names=["path", "records"]
            )

        for batch in batches:
            for archive, *parts in zip(*[batch.column(c) for c in columns]):
                if archive.as_py() != current:
                    if writer:
                        yield done()
                    current = archive.as_py()
                    name = f"{path}/{current:06d}-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(name)
                page_id, url, html, digest, kind, refers_to = [p.as_py() for p in parts]
                writer.add(record(page_id, url, html.encode(), digest, kind, refers_to))
        if writer:
            yield done()

    return settle(rows.select(*columns).mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives: ids, sizes, digests and payloads, checked against each other."""
    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )

    def number(name: str) -> int | None:
        found = name.removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found not in ("", "None") else None

    def rows_of(path: str, wanted: int) -> Iterator[tuple]:
        import hashlib

        count = 0
        for data in read_archive(path):
            fields, payload = parse(data)
            digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Bytes"])
            kind = fields["WARC-Type"]
            if kind == "response" and (size != len(payload) or digest != base32_digest(hashlib.sha1(payload).digest())):
                raise ValueError(f"a payload in {path} does not have its digest")
            refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
            count += 1
            yield number(fields["WARC-Record-ID"]), size, digest, kind, refers, payload
        if count != wanted:
            raise ValueError(f"{path} has {count} records, not {wanted}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)], names=names
            )

        for batch in batches:
            for path, wanted in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, size = [], 0
                for row in rows_of(path, wanted):
                    rows.append(row)
                    size += len(row[-1])
                    if size >= 4_000_000 or len(rows) >= 5000:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    # A row here stands for a file, so rows are dealt to as many tasks as there are
    # files; partitions of a few bytes would else be merged into one.
    tasks = min(max(archives.count(), 1), MOST_TASKS)
    dealt = archives.select("path", "records").repartition(tasks)
    return dealt.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write the pages to archives below ``path`` and read the records back."""
    return read_archives(write_archives(pages, path, least_revisit=least_revisit))
