"""WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each with whole WARC records, then a skippable
frame with the record index (record identifier -> frame, offset in the frame, length) and a skippable
frame with the seek table (compressed and plain size of every frame), as in the seekable format.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fresh_path, written
from .files import Input, Output

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
SEEK_MAGIC, SKIPPABLE_SEEK, SKIPPABLE_INDEX = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, repeat: str = "") -> str:
    """The identifier of the record of a page and payload, the same in every run; rows that repeat both, or have no page_id, differ by `repeat`."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}:{digest}:{repeat}')}>"


def record(identifier: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """The bytes of one WARC/1.1 record: response with the payload, or revisit without it, which names the response's record."""
    digest = payload_digest(payload)
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {PROFILE}", f"WARC-Payload-Length: {len(payload)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(plain: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of every record of a plain frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield at, end + 4 + size + 4 - at, head, plain[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class Bundle:
    """Writes one bundle."""

    def __init__(self, uri: str, level: int = 6):
        self.uri, self.out, self.zstd = uri, Output(uri), zstandard.ZstdCompressor(level=level)
        self.plain, self.plain_size, self.frames, self.index = [], 0, [], []

    def add(self, identifier: str, data: bytes) -> None:
        if self.plain and self.plain_size + len(data) > FRAME_BYTES:
            self.flush()
        self.index.append((identifier, len(self.frames), self.plain_size, len(data)))
        self.plain.append(data)
        self.plain_size += len(data)

    def flush(self) -> None:
        if self.plain:
            packed = self.zstd.compress(b"".join(self.plain))
            self.out.write(packed)
            self.frames.append((len(packed), self.plain_size))
            self.plain, self.plain_size = [], 0

    def close(self) -> tuple[str, int, int, int]:
        self.flush()
        rows = b"".join(uuid.UUID(i[10:-1]).bytes + struct.pack("<IQQ", f, o, n) for i, f, o, n in self.index)
        index = self.zstd.compress(rows)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        return self.uri, len(self.frames), len(self.index), self.out.size


def seek_table(f: Input) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", f.at(f.size - 9, 9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", f.at(f.size - 9 - 8 * count, 8 * count)):
        out.append((at, packed, plain))
        at += packed
    return out


def record_index(f: Input) -> dict[str, tuple[int, int, int]]:
    """Record identifier -> (frame, offset in the frame, length)."""
    frames = seek_table(f)
    at = sum(x[1] for x in frames)
    magic, size = struct.unpack("<II", f.at(at, 8))
    if magic != SKIPPABLE_INDEX:
        raise ValueError("no record index")
    rows = zstandard.decompress(f.at(at + 8, size)) if size else b""
    return {f"<urn:uuid:{uuid.UUID(bytes=i)}>": (n, o, z) for i, n, o, z in struct.iter_unpack("<16sIQQ", rows)}


def read_record(uri: str, identifier: str) -> tuple[dict[str, str], bytes]:
    """One record by its identifier: only its frame is read and decompressed."""
    with Input(uri) as f:
        frame, offset, length = record_index(f)[identifier]
        at, packed, _ = seek_table(f)[frame]
        plain = zstandard.decompress(f.at(at, packed))
    return next((head, block) for _, _, head, block in parse(plain[offset : offset + length]))


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write pages(page_id, url, html) as bundles in a folder all executors share; one row per bundle.

    Of pages with equal payloads of at least min_bytes, the one with the largest page_id is a response
    and the others are revisits of it.  A null html is an empty payload; a null url or page_id leaves
    its header out, and a page with a null page_id is never referred to.  A record's identifier follows
    from its page_id and payload; of rows with the same page_id and payload, which the join brings to one task, the first has
    that identifier and the others one of their place, so identifiers differ for all records.  A task writes its own files and names them in its result, so the files of tasks
    that ran again or were lost are in no row.  An empty table gives no bundles.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    body = F.encode("html", "utf-8")
    marks = pages.select("page_id", F.sha1(body).alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    last = marks.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
    refers = marks.join(last, "sha").where("page_id <> last").select("page_id", "sha", F.col("last").alias("refers_to"))
    rows = pages.withColumn("sha", F.sha1(body)).join(refers.distinct().hint("merge"), ["page_id", "sha"], "left")
    rows = rows.select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, done, place = None, [], 0
        task, seen = TaskContext.get(), set()
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = Bundle(f"{folder}/{task.partitionId():06d}-{uuid.uuid4().hex}.warc.zst")
                payload = html.encode()
                identifier = record_id(page_id, digest := payload_digest(payload))
                if page_id is None or identifier in seen:
                    identifier = record_id(page_id, digest, f"{task.partitionId()}:{place}")
                else:
                    seen.add(identifier)
                bundle.add(identifier, record(identifier, page_id, url, payload, refers_to))
                place += 1
                if bundle.out.size >= BUNDLE_BYTES:
                    done.append(bundle.close())
                    bundle = None
        if bundle is not None:
            done.append(bundle.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "frames", "records", "bytes"])

    return written(rows.mapInArrow(run, "path string, frames long, records long, bytes long"), "bundles")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload,
    bundle and record_id, by which read_record finds it, and refers_to_id, the identifier of the response.

    The digest and length of a response are computed from the payload read; a revisit has them in its headers.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, bundle string, record_id string, refers_to_id string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with Input(uri) as f:
                    for at, packed, _ in seek_table(f):
                        rows = []
                        for _, _, head, block in parse(zstandard.decompress(f.at(at, packed))):
                            page = head.get("WARC-Page-ID")
                            number = int(page) if page is not None else None
                            if head["WARC-Type"] == "response":
                                digest = payload_digest(block)
                                if head["WARC-Payload-Digest"] != f"sha1:{digest}":
                                    raise ValueError(f"{uri}: payload of page {page} is damaged")
                                rows.append((number, head.get("WARC-Target-URI"), "response", None, len(block), digest, block, uri, head["WARC-Record-ID"], None))
                            else:
                                rows.append((number, head.get("WARC-Target-URI"), "revisit", int(head["WARC-Refers-To-Page-ID"]), int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"][5:], None, uri, head["WARC-Record-ID"], head["WARC-Refers-To"]))
                        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    spread = bundles.select("path").repartition(max(1, bundles.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to a fresh folder of the shared root and read the archives back."""
    return read_bundles(write_bundles(pages, fresh_path(pages.sparkSession, "warc"), min_bytes))
