"""WARC archives: a deduplicating writer and a salvage reader.

Archives hold one gzip member per record. The reader goes from record to record and checks each: the member's CRC, the version line, the headers, the
block's length and digest. After a failed check it searches for the next place where a member (or, in an archive that is not
compressed, a version line) begins and passes all checks, goes on from there, and logs the bytes left out as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.llm.stores import opened, put
from quern.session import shared_dir

#: Fixed values of the format.
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: An archive is closed once it holds so many bytes.
FILE_BYTES = 32 << 20
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def digest(payload: bytes) -> str:
    """Upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def encode(headers: list[tuple[str, str]], block: bytes, compress: bool = True) -> bytes:
    """One record's bytes; Content-Length and WARC-Block-Digest are added. Line ends inside a value become spaces."""
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {re.sub(r'[\r\n]+', ' ', value)}\r\n" for name, value in headers)
    raw = VERSION + b"\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + END
    if not compress:
        return raw
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Source:
    """Reads an archive through its file, a block at a time: memory does not grow with the archive, only with its largest record."""

    BLOCK = 1 << 20

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        self.base, self.held = 0, b""
        self.next: dict[bytes, tuple[int, int]] = {}

    def read(self, start: int, n: int) -> bytes:
        """The n bytes from a place, or those up to the end."""
        n = max(0, min(n, self.size - start))
        if not self.base <= start or start + n > self.base + len(self.held):
            self._load(start, n)
        return self.held[start - self.base : start - self.base + n]

    def _load(self, start: int, n: int) -> None:
        self.file.seek(start)
        self.base, self.held = start, self.file.read(min(max(n, self.BLOCK), self.size - start))

    def find(self, what: bytes, start: int) -> int:
        """The first place of some bytes from ``start`` on; the archive's end if there is none. Places found are remembered: a search
        is made again only once ``start`` has passed what it found, so all searches together read the archive about once."""
        searched, found = self.next.get(what, (0, -1))
        if not searched <= start <= found:
            self.next[what] = (start, self._search(what, start))
        return self.next[what][1]

    def _search(self, what: bytes, at: int) -> int:
        while at + len(what) <= self.size:
            if not self.base <= at or at + len(what) > self.base + len(self.held):
                self._load(at, len(what))
            place = self.held.find(what, at - self.base)
            if place >= 0:
                return self.base + place
            at = self.base + len(self.held) - len(what) + 1
        return self.size


def _agrees(stated: str | None, content: bytes) -> bool:
    """Whether a stated digest is that of some bytes. Only SHA-1 (base32 or hex) can be checked; nothing else speaks against them."""
    algorithm, _, value = (stated or "").partition(":")
    if algorithm.lower() != "sha1":
        return True
    made = hashlib.sha1(content)
    return value.upper() == base64.b32encode(made.digest()).decode() or value.lower() == made.hexdigest()


def _body(record: Record) -> bytes:
    """A record's payload: what follows the head of an HTTP message, or the block."""
    return record.block.partition(END)[2] if record.block.startswith(b"HTTP/") else record.block


def _payload_agrees(record: Record) -> bool:
    """Whether a record's payload has the digest and length that its headers state. Revisits hold none, and writers differ on encoded transfers."""
    headers, head = record.headers, record.block.partition(END)[0].lower()
    if headers.get("warc-type") == "revisit" or (head.startswith(b"http/") and b"transfer-encoding:" in head):
        return True
    stated, length = headers.get("warc-payload-digest"), headers.get("warc-payload-length")
    if stated is None and length is None:
        return True
    payload = _body(record)
    return _agrees(stated, payload) and (length is None or length == str(len(payload)))


def _parse(source: Source, at: int, whole: bool) -> tuple[Record, int] | None:
    """The record that begins at a place, and where it ends; None if a check fails. ``whole``: it has to reach the end."""
    if not _VERSION_LINE.match(source.read(at, 10)):
        return None
    stop = source.find(END, at)
    if stop >= source.size:
        return None
    headers, line = {}, at + 10
    while line < stop:
        end = source.find(b"\r\n", line)
        name, colon, value = source.read(line, end - line).partition(b":")
        if not colon:
            return None
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        line = end + 2
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    start = stop + len(END)
    end = start + int(length)
    if source.read(end, len(END)) != END or (whole and end + len(END) != source.size):
        return None
    record = Record(headers, source.read(start, int(length)))
    if not _agrees(headers.get("warc-block-digest"), record.block) or not _payload_agrees(record):
        return None
    return record, end + len(END)


def _member(source: Source, at: int) -> tuple[Record, int] | None:
    """As _parse, for the gzip member that begins at a place; zlib checks its CRC and length."""
    if source.read(at, 3) != MEMBER:
        return None
    unpacker, parts, place = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and place < source.size:
            piece = source.read(place, 1 << 16)
            parts.append(unpacker.decompress(piece))
            place += len(piece)
            if len(parts) == 1 and not parts[0].startswith(VERSION[:7]) and len(parts[0]) >= 7:
                return None
    except zlib.error:
        return None
    if not unpacker.eof:
        return None
    raw = b"".join(parts)
    found = _parse(Source(io.BytesIO(raw), len(raw)), 0, True)
    return found and (found[0], place - len(unpacker.unused_data))


def salvage(data: bytes | Source) -> Iterator[Record | tuple[int, int]]:
    """All records of an archive that pass the checks, in order, and (start, end) of each gap of bytes between them.

    Compressed members and plain records may follow each other. An empty archive has neither. After a failed check the search goes on from the next
    place where a member or a version line begins, each looked for once.
    """
    source = data if isinstance(data, Source) else Source(io.BytesIO(data), len(data))
    at, lost = 0, None
    while at < source.size:
        found = _member(source, at) or _parse(source, at, False)
        if found:
            if lost is not None:
                yield lost, at
                lost = None
            yield found[0]
            at = found[1]
            continue
        lost = at if lost is None else lost
        at = min(source.find(MEMBER, at + 1), source.find(VERSION[:7], at + 1))
    if lost is not None:
        yield lost, source.size


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def _response(page_id: int | None, url: str | None, payload: bytes, stated: str) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + END
    return encode(_common("response", page_id, url, len(payload), stated), head + payload)


def _common(kind: str, page_id: int | None, url: str | None, length: int, stated: str) -> list[tuple[str, str]]:
    return [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", url)] if url is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{stated}"),
        ("WARC-Payload-Length", str(length)),
    ]


def _revisit(page_id: int | None, url: str | None, length: int, stated: str, first: int | None) -> bytes:
    extra = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if first is None else first}>")]
    return encode([*_common("revisit", page_id, url, length, stated), *extra], b"HTTP/1.1 200 OK" + END)


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per page row and returns the manifest: file, records, bytes.

    Of the rows of one payload of ``least`` bytes or more, just one is stored whole: the row of the smallest page_id (null ids last, then the smallest
    url), and if that row is repeated, one of its copies. All the others get revisit records, the other copies too (these revisit their own
    page_id). Shorter payloads are stored with each row. Null html is an empty payload. No pages: no files.

    Payloads are shuffled only to bring each to its one record, and are combined before the shuffle, so a payload that a third of all rows share is one row a
    task. What the other rows need is slim: digest, id, url, length and how many equal rows there are; both sides of their join are written
    tables, so that Spark splits the rows of a very common payload. A task's rows are sorted, so that if it is repeated it writes the same files.
    """
    payload = _payload(F.col("html"))
    length, sha1 = F.octet_length(payload).cast("long"), F.sha1(payload)
    order = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id"), F.col("url").isNull().alias("no_url"), F.col("url"))
    slim = pages.select(sha1.alias("sha1"), "page_id", "url", length.alias("length"), F.when(length < least, payload).alias("short"))
    groups = written(slim.groupBy("sha1", "page_id", "url").agg(F.count("*").alias("n"), F.first("length").alias("length"), F.first("short").alias("short")), "digests")
    firsts = written(groups.filter(F.col("length") >= least).groupBy("sha1").agg(F.min(order).alias("first")), "firsts").withColumnRenamed("sha1", "of")
    others = groups.join(firsts, F.col("sha1") == F.col("of"), "left")
    is_first = F.col("of").isNotNull() & F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url"))
    others = others.withColumn("times", F.col("n") - is_first.cast("int")).filter("times > 0")
    others = others.select("page_id", "url", "sha1", "length", F.col("short").alias("payload"), F.col("first.page_id").alias("first_id"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_k")).drop("_k")
    whole = pages.select(sha1.alias("sha1"), length.alias("length"), order.alias("order"), "html").filter(F.col("length") >= least)
    whole = whole.groupBy("sha1").agg(F.min("order").alias("first"), F.first("length").alias("length"), F.first("html").alias("html"))
    whole = whole.select("first.page_id", "first.url", "sha1", "length", payload.alias("payload"), F.lit(None).cast("long").alias("first_id"))
    rows = whole.unionByName(others).sortWithinPartitions("page_id", "url", "sha1", "payload")

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held, size, count = TaskContext.get().partitionId(), [], [], 0, 0

        def close() -> None:
            name = f"part-{part:06d}-{len(rows):04d}.warc.gz"
            put(folder, name, b"".join(held))
            rows.append({"file": name, "records": count, "bytes": size})

        for batch in batches:
            for row in batch.to_pylist():
                stated = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                if row["payload"] is None:
                    record = _revisit(row["page_id"], row["url"], row["length"], stated, row["first_id"])
                else:
                    record = _response(row["page_id"], row["url"], row["payload"], stated)
                held.append(record)
                size, count = size + len(record), count + 1
                if size >= FILE_BYTES:
                    close()
                    held, size, count = [], 0, 0
        if held:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    return written(rows.mapInArrow(save, "file string, records long, bytes long"), "archives")


_RECORDS = "file string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long"


def _id(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read(spark, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives in a folder (any name that ends with .warc or .warc.gz).

    A record: file, page_id, url, payload_bytes, payload_digest (of the full payload; a response's are measured again, and a record whose headers state others is
    quarantined), record_type, refers_to, payload (null for revisits, or without ``payloads``). A gap: file, gap_start, gap_end, all else null.
    Archives are read by one task each, from front to back and a block at a time: where a record begins is known only once the one before it
    has been checked, as a payload may hold records too. Several archives go through at once.
    """
    names = [f.name for f in _schema()]

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns)):
                name, out, size = path.rpartition("/")[2], [], 0
                with opened(path) as file:
                    for found in salvage(Source(file, length)):
                        out.append(dict.fromkeys(names) | {"file": name} | (_row(found, payloads) if isinstance(found, Record) else {"gap_start": found[0], "gap_end": found[1]}))
                        size += len(out[-1]["payload"] or b"")
                        if len(out) >= 5000 or size >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=_schema())
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_schema())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "length")
    return files.mapInArrow(load, _RECORDS)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in _RECORDS.split(", "))])


def _row(record: Record, payloads: bool) -> dict:
    h = record.headers
    kind, stated = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:")
    out = {"page_id": _id(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": kind, "payload_digest": stated or None}
    if kind == "revisit":
        length = h.get("warc-payload-length", "")
        return out | {"refers_to": _id(h.get("warc-refers-to")), "payload_bytes": int(length) if length.isdigit() else None}
    payload = _body(record)
    return out | {"payload_bytes": len(payload), "payload_digest": digest(payload), "payload": payload if payloads else None}


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes all pages to archives in a new shared folder and reads them back. No pages: no rows."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    if write(pages, folder).isEmpty():
        return spark.createDataFrame([], _RECORDS)
    return read(spark, folder, payloads)
