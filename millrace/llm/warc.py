"""WARC records in ZIP-packaged archives: a writer, and a reader that range-reads stored members.

An archive is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, one gzip member
per record, and `indexes/index.cdxj`, one line per record with its file name, offset and length. The reader
parses the end-of-directory record, its ZIP64 extension where sizes or counts overflow, and the
central directory; finds the index and the archive members; and reads each record by its byte range
through any seekable file, without extracting a member. An index may name any member of `archive/`; without
a name it is the only one. Indexes and archive members that are not stored are refused.

On Spark the archives are files in the shared folder, written by the tasks that hold the records and
listed in a table of paths: an attempt names its files anew, so what a lost one left is read by
nobody. A reading task opens an archive where it lies, in a file system that pyarrow knows (Spark's names for them are
turned into Arrow's; any other is refused before work starts), and reads the directory, the index and then each record by its range. Archives roll over at ARCHIVE_BYTES, a
writing task holds one at a time, a reading task one record.

Payloads of at least MIN_SHARED bytes that are equal are stored once: the record with the largest
page id is the `response`, the others are `revisit` records that name its id and carry no payload.
Equality is decided on (SHA-1, length) with map-side aggregation, so no group is collected.

Defined cases: page ids are integers; null payloads are empty; empty and short payloads are always responses; null page ids
never win against others and are written as an empty id; rows that repeat an id and a payload are
all responses if that id is the largest; an empty table gives no archives; a very long payload is an archive of its own;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.handoff import opened
from .common import bounded, column, materialize, scratch_path, slices, tidy

MIN_SHARED = 1000
ARCHIVE_BYTES = 8 << 20
#: Records that a reading task hands on at a time.
READ_ROWS = 500
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format: signatures, and the sizes and counts that point to ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record, uncompressed. A revisit has no payload and names the record it refers to."""
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:20]}")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ZIP64 fields are written where they are needed, or everywhere if asked."""
    out, directory = io.BytesIO(), b""
    for name, data in members:
        at, path, crc = out.tell(), name.encode(), zlib.crc32(data)
        big = zip64 or len(data) >= FULL32 or at >= FULL32
        size = FULL32 if big else len(data)
        version = 45 if big else 20
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        out.write(struct.pack("<IHHHHHIIIHH", LOCAL, version, 0x800, 0, 0, 33, crc, size, size, len(path), len(extra)) + path + extra)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        directory += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, version, version, 0x800, 0, 0, 33, crc, size, size, len(path), len(extra), 0, 0, 0, 0, FULL32 if big else at) + path + extra
    at, n = out.tell(), len(members)
    out.write(directory)
    if zip64 or at + len(directory) >= FULL32 or n >= FULL16:
        end = out.tell()
        out.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, len(directory), at))
        out.write(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
        out.write(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
    else:
        out.write(struct.pack("<IHHHHIIH", END, 0, 0, n, n, len(directory), at, 0))
    return out.getvalue()


def read_range(f: BinaryIO, at: int, size: int) -> bytes:
    f.seek(at)
    data = f.read(size)
    if len(data) != size:
        raise ValueError("the archive is cut short")
    return data


def zip_directory(f: BinaryIO) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the data, size) of the stored members, from the central directory."""
    total = f.seek(0, 2)
    tail_at = max(0, total - 22 - FULL16)
    tail = read_range(f, tail_at, total - tail_at)
    end = tail.rfind(struct.pack("<I", END))
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(struct.pack("<I", END), 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    n, size, at = struct.unpack_from("<HII", tail, end + 10)
    if n == FULL16 or size == FULL32 or at == FULL32:
        sign, _, where, _ = struct.unpack("<IIQI", read_range(f, tail_at + end - 20, 20))
        if sign != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        sign, *_, n, size, at = struct.unpack("<IQHHIIQQQQ", read_range(f, where, 56))
        if sign != END64:
            raise ValueError("no ZIP64 end of directory")
    directory, pos, found = read_range(f, at, size), 0, {}
    for _ in range(n):
        sign, _, _, _, method, _, _, _, packed, plain, names, extras, comment, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, pos)
        if sign != CENTRAL:
            raise ValueError("a bad central directory entry")
        name = directory[pos + 46 : pos + 46 + names].decode()
        extra, x = directory[pos + 46 + names : pos + 46 + names + extras], 0
        while x + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, x)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, x + 4))
                plain = wide.pop(0) if plain == FULL32 else plain
                packed = wide.pop(0) if packed == FULL32 else packed
                offset = wide.pop(0) if offset == FULL32 else offset
            x += 4 + length
        pos += 46 + names + extras + comment
        if method == 0:
            sign, *_, names, extras = struct.unpack("<IHHHHHIIIHH", read_range(f, offset, 30))
            if sign != LOCAL:
                raise ValueError("a bad local header")
            found[name] = (offset + 30 + names + extras, plain)
        elif name.startswith(("archive/", "indexes/")) and not name.endswith("/"):
            raise ValueError(f"a member is not stored: {name}")
    return found


def archive(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of gzip-compressed records (key, record) and their index."""
    data, lines, at = [], [], 0
    for key, rec in records:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        gz = pack.compress(rec) + pack.flush()
        lines.append(json.dumps({"key": key, "filename": DATA.removeprefix("archive/"), "offset": at, "length": len(gz)}))
        data.append(gz)
        at += len(gz)
    return zip_stored([(DATA, b"".join(data)), (INDEX, "\n".join(lines).encode())])


def read_archive(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of every record that an index of the archive lists, each read by its byte range."""
    members = zip_directory(f)
    files = {n.removeprefix("archive/"): place for n, place in members.items() if n.startswith("archive/") and not n.endswith("/")}
    for name, (at, size) in sorted(members.items()):
        if name.startswith("indexes/") and not name.endswith("/"):
            for line in read_range(f, at, size).splitlines():
                entry = json.loads(line)
                file = entry.get("filename") or (next(iter(files)) if len(files) == 1 else None)
                if file not in files:
                    raise ValueError(f"an index entry names no archive member: {file}")
                base, limit = files[file]
                if entry["offset"] + entry["length"] > limit:
                    raise ValueError("an index entry is out of range")
                yield parse_record(zlib.decompress(read_range(f, base + entry["offset"], entry["length"]), 31))


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_shared: int = MIN_SHARED) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to of every page."""
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    hashed = pages.select(
        F.col(key).alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size")
    )
    shared = (
        hashed.where(F.col("size") >= min_shared).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    shared = bounded(materialize(shared, "shared"))  # payloads are not shuffled unless very many are shared
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return hashed.join(shared, ["digest", "size"], "left").withColumn("refers_to", refers).drop("first")


def write_archives(planned: DataFrame, limit: int = ARCHIVE_BYTES, folder: str | None = None) -> DataFrame:
    """(path, records): the records of each task in archive files of about `limit` bytes of records, under `folder` or in the shared folder."""
    folder = folder or scratch_path(planned.sparkSession, "archives")
    opened(folder)  # an unknown scheme or a library that is not there is refused before any work

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        attempt, written, size, held = f"{TaskContext.get().partitionId():06}-{uuid.uuid4().hex}", 0, 0, []
        for b in slices(batches, 200):
            names = ("page_id", "url", "payload", "digest", "size", "refers_to")
            for row in zip(*(column(b, n).to_pylist() for n in names), strict=True):
                held.append((str(row[0]), record(*row)))
                size += len(held[-1][1])
                if size >= limit:
                    yield out(store, f"{base}/{attempt}-{written:06}.wacz", held)
                    written, size, held = written + 1, 0, []
        if held:
            yield out(store, f"{base}/{attempt}-{written:06}.wacz", held)

    def out(store: fs.FileSystem, path: str, held: list) -> pa.RecordBatch:
        with store.open_output_stream(path, compression=None) as f:
            f.write(archive(held))
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([len(held)], pa.int64())], ["path", "records"])

    return materialize(planned.mapInArrow(run, "path string, records long"), "archive-list", 200)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest (bare hex SHA-1), refers_to, and payload if asked, of the archives at `path`.

    Length and digest of a response are taken from its payload, which must agree with its header; a
    revisit has those of the payload it stands for.
    """

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in column(b, "path").to_pylist():
                store, place = opened(path)
                rows = []
                with store.open_input_file(place) as f:
                    for fields, payload in read_archive(f):
                        kind, digest = fields["WARC-Type"], base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(fields["WARC-Payload-Length"])
                        if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError("a payload differs from its digest")
                        rows.append((ident(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, size, digest, ident(fields.get("WARC-Refers-To", "")), payload if payloads and kind == "response" else None))
                        if len(rows) >= READ_ROWS or payloads and size >= 1 << 20:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))[: len(names)] or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names)

    def ident(urn: str) -> int | None:
        found = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(found) if found else None

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: 6 + payloads]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    # the list of paths is small: its rows are dealt out, a few to a task
    tasks = max(1, min(archives.count(), 8 * archives.sparkSession.sparkContext.defaultParallelism))
    return archives.select("path").repartition(tasks).mapInArrow(run, schema)
