"""Web pages as WARC archives, and a reader that takes any byte range of them.

Every record is a gzip member of its own. A reading task scans its range for the gzip magic,
accepts a candidate when it decodes to a WARC header (of any length) and its checksum holds, and owns the records
that start inside the range, to their ends beyond it. After an accepted member the next one starts
where it ended, so only a range's first record is searched for. (Compressed data does not decode
to a WARC header by chance, and UTF-8 payloads never contain the magic.)

Archives are written and read through pyarrow's file systems, which know local, HDFS and object
store addresses. A task names its file anew at each attempt and reports it in its result, so the
manifest lists the files of successful attempts only.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import fresh_folder, written

MAGIC = b"\x1f\x8b\x08"
GZIP = 31  # zlib's number for gzip members
LEVEL = 4
ARCHIVE_BYTES = 1 << 30
SPLIT_BYTES = 32 << 20
BLOCK = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, bytes long, records long"
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One compressed record; a revisit keeps the HTTP header with the payload's length only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_header_value(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _fields(header: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in header.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(identifier: str | None) -> int | None:
    number = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse(member: bytes) -> tuple:
    """Values in the order of ``RECORD`` of a decoded member; wrong lengths and digests are errors."""
    header, _, rest = member.partition(b"\r\n\r\n")
    fields = _fields(header)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and digest_of(payload) != digest:
        raise ValueError(f"payload of record {fields.get('warc-record-id')} has another digest")
    return (
        _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), int(_fields(http)["content-length"]), digest,
        kind, _page(fields.get("warc-refers-to")), payload if kind == "response" else None,
    )


class _Range:
    """Bytes of a file from some place on, read in blocks as they are asked for."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        self.file, self.base, self.size = file, at, file.size()
        self.data = b""

    def more(self) -> bool:
        at = self.base + len(self.data)
        got = self.file.read_at(min(BLOCK, self.size - at), at) if at < self.size else b""
        self.data += got
        return bool(got)

    def drop(self, count: int) -> None:
        self.data, self.base = self.data[count:], self.base + count


def _member(source: _Range, at: int) -> tuple[bytes, int] | None:
    """The decoded member at ``at`` and where it ends, or None if there is no WARC record."""
    decoder, decoded, taken = zlib.decompressobj(GZIP), [], at
    seen = b""
    try:
        while not decoder.eof:
            if taken == len(source.data) and not source.more():
                return None
            chunk = source.data[taken : taken + BLOCK]
            decoded.append(decoder.decompress(chunk))
            taken += len(chunk) - len(decoder.unused_data)
            if len(seen) < 7:
                seen += decoded[-1][:7]
                if not (seen.startswith(b"WARC/1.") or b"WARC/1.".startswith(seen)):
                    return None
    except zlib.error:
        return None
    whole = b"".join(decoded)
    return (whole, taken) if whole.startswith(b"WARC/1.") and b"\r\n\r\n" in whole else None


def members(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    """Decoded records that start in [start, stop)."""
    source, at = _Range(file, start), 0
    while source.base + at < stop:
        while (found := source.data.find(MAGIC, at)) < 0:
            at = max(at, len(source.data) - 2)
            if source.base + at >= stop or not source.more():
                return
        if source.base + found >= stop:
            return
        member = _member(source, found)
        if member is None:
            at = found + 1
            continue
        yield member[0]
        source.drop(member[1])
        at = 0


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, record_type, refers_to.

    Of rows with equal payloads of at least ``least_bytes`` the one with the largest page_id is
    the response (all rows of that id, if it repeats); if none of them has an id, all are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("content", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("content").agg(
        F.count("*").alias("n"), F.max("page_id").alias("refers_to")
    )
    repeated = written(groups.where("n > 1 and refers_to is not null").drop("n"), "repeated-payloads")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return rows.join(repeated, "content", "left").select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("refers_to")).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` under ``folder``; path, bytes and records of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = file_system(folder)
        store.create_dir(where, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, count = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size, count = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{where}/{name}", compression=None)
                size += out.write(record(page_id, url, payload, refers_to, revisit, date))
                count += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        if done:
            names, sizes, counts = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{n}" for n in names]), pa.array(sizes), pa.array(counts)], ["path", "bytes", "records"]
            )

    chosen = records.select("page_id", "url", "payload", "revisit", "refers_to")
    return written(chosen.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (path, bytes), one task to each byte range."""
    splits = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n_splits = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    names = [field.split(" ")[0] for field in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    wanted = len(names) if with_payload else len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, _, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, where = file_system(path)
                with store.open_input_file(where) as file:
                    rows, held = [], 0
                    for member in members(file, start, start + split_bytes):
                        rows.append(parse(member)[:wanted])
                        held += len(member) if with_payload else 200
                        if held >= 16 << 20:
                            yield _batch(rows, types, names)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, types, names)

    schema = ", ".join(RECORD.split(", ")[:wanted])
    return splits.repartition(math.ceil(n_splits)).mapInArrow(run, schema)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(values, t) for values, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names[: len(columns)])


def check_count(records: DataFrame, manifest: DataFrame) -> None:
    """Fewer or more records than the manifest says are an error."""
    wanted, got = manifest.agg(F.sum("records")).first()[0] or 0, records.count()
    if wanted != got:
        raise ValueError(f"{got} records read of {wanted} written")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back, without the payloads.

    Null html is an empty payload; null urls have no target header; null ids stay null. Repeated
    rows give a record each. An empty table gives no archive and no rows. Columns other than
    page_id, url and html are not read.
    """
    folder = fresh_folder(pages.sparkSession, "warc")
    manifest = write_archives(with_revisits(pages, least_bytes), folder)
    records = written(read_archives(manifest, split_bytes, with_payload=False), "warc-records")
    check_count(records, manifest)
    return records
