"""Web archives in ZIP packages, read by ranges.

Each task writes its records to packages of the shared folder: a WARC member with one gzip block a
record, and an index member with a line a record (id, offset, length, type). Both members are
stored, not compressed again, so a reader needs only the package's directory (central directory,
and the ZIP64 one where sizes ask for it), the index, and a range a record; nothing is unpacked.
Packages are named anew in each attempt and listed in a table that only attempts that ended are in,
so lost executors leave at most files that nothing reads.

Of records with equal payloads of at least min_revisit bytes, that with the smallest page_id is a
response; the others are revisits, which keep the response's HTTP head (with the payload's length)
and digest and refer to it, but hold no payload.

Defined cases: null html is an empty payload; rows that repeat the response's page_id and payload
are responses too; rows without page_id are revisits of an equal page with one, else responses; an
empty table writes no package; a null url becomes an empty target.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store
from .text import chunks

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# --- ZIP ---------------------------------------------------------------------------------


class ZipWriter:
    """Stored members one after the other; zip64: also where sizes would do without."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at = out, zip64, 0
        self.members: list[tuple[bytes, int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts: Iterator[bytes], crc: int, size: int) -> None:
        raw, start, big = name.encode(), self.at, self.zip64 or size >= FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = FULL32 if big else size
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for part in parts:
            self._put(part)
        self.members.append((raw, start, crc, size))

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.members:
            big = self.zip64 or size >= FULL32 or offset >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            shown, where = (FULL32, FULL32) if big else (size, offset)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra)
        length, n = self.at - start, len(self.members)
        if self.zip64 or start >= FULL32 or n >= FULL16:
            end = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
            self._put(END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        else:
            self._put(END + struct.pack("<HHHHIIH", 0, 0, n, n, length, start, 0))


class ZipReader:
    """The directory of a package, and ranges of its stored members. source: seekable and readable."""

    def __init__(self, source):
        self.source = source
        source.seek(0, io.SEEK_END)
        size = source.tell()
        tail = self._range(max(0, size - 65_557), min(size, 65_557))
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no ZIP directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if (n, length, start) == (n, FULL32, start) or start == FULL32 or n == FULL16:
            where = at - 20
            if where < 0 or tail[where : where + 4] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            end64 = self._range(struct.unpack_from("<Q", tail, where + 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 directory")
            n, length, start = struct.unpack_from("<QQQ", end64, 32)
        self.members = dict(self._central(self._range(start, length), n))

    def _range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    @staticmethod
    def _central(data: bytes, n: int):
        at = 0
        for _ in range(n):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", data, at + 10)[0]
            packed, size, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", data, at + 20)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode()
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    size = next(wide) if size == FULL32 else size
                    packed = next(wide) if packed == FULL32 else packed
                    offset = next(wide) if offset == FULL32 else offset
                extra = extra[4 + length :]
            yield name, (method, offset, packed, size)
            at += 46 + n_name + n_extra + n_note

    def locate(self, name: str) -> tuple[int, int]:
        """Where the stored member's bytes start, and how many there are."""
        method, offset, packed, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed, so it can't be read by ranges")
        n_name, n_extra = struct.unpack_from("<HH", self._range(offset, 30), 26)
        return offset + 30 + n_name + n_extra, packed

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        start, size = self.locate(name)
        return self._range(start + at, size - at if n is None else min(n, size - at))


# --- WARC --------------------------------------------------------------------------------


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """A gzip block with a response record, or with a revisit record if refers_to is given."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    whole = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return gzip.compress(whole, 1, mtime=0)


def _page(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(packed: bytes) -> dict:
    """The record of a gzip block: page_id, url, record_type, payload (None in revisits), payload_bytes, payload_digest, refers_to."""
    head, _, rest = gzip.decompress(packed).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    out = {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": length, "payload": None, "refers_to": None}
    if fields["WARC-Type"] == "revisit":
        return out | {"refers_to": _page(fields["WARC-Refers-To"])}
    if len(payload) != length or hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        raise ValueError(f"record of page {out['page_id']} is damaged")
    return out | {"payload": payload}


def write_package(path: str, records: list[tuple[bytes, str]], zip64: bool = False) -> None:
    """records: packed blocks, and what the index has of each."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    at, lines = 0, []
    for packed, about in records:
        lines.append(f"{about} {at} {len(packed)}\n")
        at += len(packed)
    index, crc = "".join(lines).encode(), 0
    for packed, _ in records:
        crc = zlib.crc32(packed, crc)
    with fs.open_output_stream(name) as out:
        package = ZipWriter(out, zip64)
        package.add(ARCHIVE, (p for p, _ in records), crc, at)
        package.add(INDEX, iter([index]), zlib.crc32(index), len(index))
        package.close()


def read_package(path: str, window: int = 4 << 20) -> Iterator[dict]:
    """All records of a package, by the ranges its index names; neighbours are fetched together, up to window bytes."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as source:
        package = ZipReader(source)
        start, _ = package.locate(ARCHIVE)
        wanted = [tuple(map(int, line.rsplit(" ", 2)[1:])) for line in package.read(INDEX).decode().splitlines()]
        held, base = b"", 0
        for i, (at, n) in enumerate(wanted):
            if at < base or at + n > base + len(held):
                end = at + n
                for a, m in wanted[i + 1 :]:
                    if a != end or a + m - at > window:
                        break
                    end = a + m
                base, held = at, package._range(start + at, end - at)
            yield parse(held[at - base : at - base + n])


def _write(folder: str, limit: int, zip64: bool):
    def run(batches):
        records: list[tuple[bytes, str]] = []
        size = 0

        def out():
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            write_package(path, records, zip64)
            n = len(records)
            records.clear()
            return pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

        for batch, payloads in chunks(batches, "html", limit=4 << 20):
            ids, urls, digests, refers = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("page_id", "url", "digest", "refers_to"))
            for page, url, digest, to, payload in zip(ids, urls, digests, refers, payloads, strict=True):
                packed = record(page, url, payload, digest, to)
                records.append((packed, f"{page} {'response' if to is None else 'revisit'}"))
                size += len(packed)
                if size >= limit:
                    yield out()
                    size = 0
        if records:
            yield out()

    return run


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def _read(payloads: bool):
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                size = 0
                for row in read_package(path):
                    size += len(row["payload"] or b"") + 200
                    if not payloads:
                        del row["payload"]
                    rows.append(row)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, v) for k, v in FIELDS.items() if payloads or k != "payload"]))
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, v) for k, v in FIELDS.items() if payloads or k != "payload"]))

    return run


def write_archives(pages: DataFrame, store: Store, min_revisit: int = 100, package_bytes: int = 32 << 20, zip64: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html) to packages; a row a package: path, records."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    sized = own.where(F.octet_length("html") >= min_revisit)
    firsts = store.put(sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    # null-safe: without a page_id on either side nothing is referred to
    joined = own.join(firsts, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    found = joined.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(f"{store.path}/packages", package_bytes, zip64), "path string, records long")
    return store.put(found, "written")


def read_archives(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of packages (path): page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, url string, " + "payload binary, " * payloads + "payload_bytes long, payload_digest string, record_type string, refers_to long"
    # one row a package, so packages are dealt out by number, not by size
    return packages.select("path").repartition(max(1, packages.sparkSession.sparkContext.defaultParallelism * 2)).mapInArrow(_read(payloads), schema)
