"""WARC archives as seekable Zstandard bundles.

Every task writes one bundle: records are grouped into independent Zstandard frames of about FRAME_BYTES, and a seek table in a skippable
frame ends the file (the published seekable format). An index table maps record ids to bundle, frame and the record's offset in the frame,
so that one record is read by one seek and one frame. Bundles are named by task attempt and only the index of a committed attempt names
them, so a lost executor or a second attempt never mixes files.

Of records with equal payloads of at least `revisit_bytes`, those with the largest page id are responses and the others revisit it. Which rows
revisit is found from digests alone; the pages are then dealt by page id, so a payload that many pages share gathers nowhere.

Defined results: a null html has an empty payload; a null url is left out of the header; a null page id sorts below all others (records with equal
payloads that all lack an id are all responses); rows that repeat the largest id and the payload are all responses; extra columns are ignored; an empty
table gives an empty result.
"""
from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.session import shared_folder, stage

FRAME_BYTES, LEVEL = 1 << 18, 3
# Fixed values of the seekable format: magic numbers of the skippable frame and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    """The record id of a page with a payload digest (repeated rows repeat it)."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 response record, or a revisit record that keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Named fields, HTTP header and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not at the start of a record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


class BundleWriter:
    """Writes records to independent frames and ends with the seek table."""

    def __init__(self, sink):
        self.sink, self.frames, self.held, self.size = sink, [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame of the added record."""
        if self.held and self.size + len(data) > FRAME_BYTES:
            self.flush()
        at = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.compressor.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw)))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads single records of a bundle by frame and offset; the last frame stays open."""

    def __init__(self, source, size: int):
        self.source, self.last = source, (-1, b"")
        source.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or descriptor & 0x7F:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8
        source.seek(size - 9 - count * width)
        table = source.read(count * width)
        self.frames, at = [], 0
        for k in range(count):
            packed, raw = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, raw))
            at += packed

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            at, packed, raw = self.frames[frame]
            self.source.seek(at)
            self.last = frame, zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=raw)
        return self.last[1][offset:offset + length]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def revisits(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """page_id, digest and refers_to of the rows whose payload another row with a larger id holds."""
    html = F.coalesce("html", F.lit(""))
    small = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= revisit_bytes)
    kept = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return small.join(kept, "digest").where("page_id IS NULL OR page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_bundles(pages: DataFrame, folder: str, revisit_bytes: int = 1000) -> DataFrame:
    """Write all pages to bundles in `folder`; returns the index: record_id, page_id, bundle, frame, offset, length."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    again = revisits(pages, revisit_bytes).withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        context = TaskContext.get()
        name = f"bundle-{context.partitionId():05d}-{context.taskAttemptId()}.warc.zst"
        sink, writer = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}", compression=None)  # frames are compressed here
                writer = BundleWriter(sink)
                info = b"software: seekable bundle writer\r\nformat: WARC File Format 1.1\r\n"
                writer.add(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\n"
                           f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, url, html, digest, refers = row
                data = record(page, url, html.encode(), digest, refers)
                frame, offset = writer.add(data)
                out.append((record_id(page, digest), page, name, frame, offset, len(data)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)],
                                  names=["record_id", "page_id", "bundle", "frame", "offset", "length"])
        if sink is not None:
            writer.close()
            sink.close()
    return stage(rows.mapInArrow(run, "record_id string, page_id long, bundle string, frame long, offset long, length long"))


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of all records of an index."""
    def run(table: pa.Table) -> pa.Table:
        fs, root = _open(folder)
        path = f"{root}/{table.column('bundle')[0].as_py()}"
        size = fs.get_file_info(path).size
        places = sorted(zip(*(table.column(c).to_pylist() for c in ("frame", "offset", "length")), strict=True))
        out = []
        with fs.open_input_file(path) as source:
            reader = BundleReader(source, size)
            for place in places:
                fields, http, payload = parse(reader.record(*place))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                page, refers = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
                length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record of page {page} in {path}")
                out.append((None if page is None else int(page), length, digest, kind, None if refers is None else int(refers), payload.decode() if kind == "response" else None))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    return index.select("bundle", "frame", "offset", "length").groupBy("bundle") \
        .applyInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def archive_round_trip(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Write all pages to bundles in the shared folder and describe what the bundles hold."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder, revisit_bytes), folder).drop("payload")


def check_bundle(data: bytes) -> list[dict[str, str]]:
    """Fields of all records of a bundle, read frame by frame (for tools and tests)."""
    reader, found = BundleReader(io.BytesIO(data), len(data)), []
    for k, (_, _, raw) in enumerate(reader.frames):
        frame, at = reader.record(k, 0, raw), 0
        while at < len(frame):
            fields, _, _ = parse(frame[at:])
            found.append(fields)
            at += frame[at:].index(b"\r\n\r\n") + 4 + int(fields["Content-Length"]) + 4
    return found
