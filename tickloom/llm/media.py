"""Media columns: signature sniffing, structural validation, type correction and carving."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written

BLOCK = 64
DECLARED = "application/octet-stream"

# ---------------------------------------------------------------- validators: length of a whole object at an offset, or None


class Marks:
    """What validators of one media object share, so that each part of it is looked through once, however many
    signatures it has."""

    def __init__(self, data: bytes):
        self.data = data
        self.walked: dict[tuple[int, bool | None], int | None] = {}  # JPEG: place and whether a scan was met -> end; None: start of a scan -> the mark after it

    def _places(self, magic: bytes) -> list[int]:
        out, at = [], self.data.find(magic)
        while at >= 0:
            out.append(at)
            at = self.data.find(magic, at + 1)
        return out

    @cached_property
    def eofs(self) -> list[int]:
        return self._places(b"%%EOF")

    @cached_property
    def xrefs(self) -> list[int]:
        return self._places(b"startxref")

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start of a ZIP archive by its end records -> its first end."""
        out: dict[int, int] = {}
        for end in self._places(b"PK\x05\x06"):
            if end + 22 <= len(self.data):
                size, start, note = struct.unpack_from("<IIH", self.data, end + 12)
                if end + 22 + note <= len(self.data):
                    out.setdefault(end - start - size, end + 22 + note)
        return out


def riff(data: bytes, at: int, marks: Marks) -> int | None:
    """RIFF of any form: the chunks must fill the stated size; wav needs fmt and data."""
    if len(data) < at + 12:
        return None
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    if size < 12 or at + size > len(data):
        return None
    pos, seen = at + 12, set()
    while pos < at + size:
        if pos + 8 > at + size:
            return None
        kind, n = struct.unpack_from("<4sI", data, pos)
        seen.add(kind)
        pos += 8 + n + (n & 1)
    if pos != at + size:
        return None
    return size if data[at + 8 : at + 12] != b"WAVE" or {b"fmt ", b"data"} <= seen else None


def png(data: bytes, at: int, marks: Marks) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, pos)
        if pos + 12 + n > len(data) or first and (kind != b"IHDR" or n != 13):
            return None
        if zlib.crc32(data[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", data, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return pos - at
    return None


def gif(data: bytes, at: int, marks: Marks) -> int | None:
    if len(data) < at + 13:
        return None
    pos, flags = at + 13, data[at + 10]
    pos += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    while pos < len(data):
        mark = data[pos]
        if mark == 0x3B:
            return pos + 1 - at
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 < len(data):
            local = data[pos + 9]
            pos += 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)
        else:
            return None
        while pos < len(data) and data[pos]:
            pos += data[pos] + 1
        pos += 1
    return None


def jpeg(data: bytes, at: int, marks: Marks) -> int | None:
    """Segments up to the end mark after a scan; a walk that meets an earlier one's place has its end."""
    pos, scanned, path, end = at + 2, False, [], None
    while pos + 2 <= len(data) and data[pos] == 0xFF:
        if (pos, scanned) in marks.walked:
            end = marks.walked[pos, scanned]
            break
        path.append((pos, scanned))
        mark = data[pos + 1]
        if mark == 0xD9:
            end = pos + 2 if scanned else None
            break
        if pos + 4 > len(data) or (n := struct.unpack_from(">H", data, pos + 2)[0]) < 2:
            break
        pos += 2 + n
        if mark == 0xDA:
            scanned = True
            if (pos, None) in marks.walked:
                pos = marks.walked[pos, None]
            else:
                began, pos = pos, data.find(b"\xff", pos)
                while 0 <= pos < len(data) - 1 and (data[pos + 1] == 0 or 0xD0 <= data[pos + 1] <= 0xD7):
                    pos = data.find(b"\xff", pos + 2)
                pos = marks.walked[began, None] = pos if 0 <= pos < len(data) - 1 else len(data)
    marks.walked.update(dict.fromkeys(path, end))
    return end and end - at


def bmp(data: bytes, at: int, marks: Marks) -> int | None:
    if len(data) < at + 54:
        return None
    size, zero, start, head, _, _, planes, bits = struct.unpack_from("<IIIIiiHH", data, at + 2)
    good = zero == 0 and planes == 1 and head in (40, 52, 56, 108, 124) and bits in (1, 4, 8, 16, 24, 32) and 54 <= start <= size
    return size if good and at + size <= len(data) else None


def gzip(data: bytes, at: int, marks: Marks) -> int | None:
    unpack = zlib.decompressobj(31)
    pos = at
    try:
        while not unpack.eof and pos < len(data):
            unpack.decompress(data[pos : pos + 65536], 1 << 20)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            pos += 65536
    except zlib.error:
        return None
    return min(pos, len(data)) - len(unpack.unused_data) - at if unpack.eof else None


def pdf(data: bytes, at: int, marks: Marks) -> int | None:
    i = bisect_left(marks.eofs, at)
    if i == len(marks.eofs):
        return None
    j = bisect_left(marks.xrefs, at)
    return marks.eofs[i] + 5 - at if j < len(marks.xrefs) and marks.xrefs[j] < marks.eofs[i] else None


def zipped(data: bytes, at: int, marks: Marks) -> int | None:
    if len(data) < at + 30 or struct.unpack_from("<H", data, at + 8)[0] not in (0, 8, 9, 12, 14, 93, 95):
        return None
    end = marks.archives.get(at)
    return end and end - at


def ogg(data: bytes, at: int, marks: Marks) -> int | None:
    pos = at
    while data[pos : pos + 4] == b"OggS" and pos + 27 <= len(data):
        flags, n = data[pos + 5], data[pos + 26]
        table = data[pos + 27 : pos + 27 + n]
        pos += 27 + n + sum(table)
        if len(table) < n or pos > len(data):
            return None
        if flags & 4:
            return pos - at
    return None


#: Magic bytes -> (type, validator); fixed values of the formats.
SIGNATURES: dict[bytes, tuple[str, Callable[[bytes, int, Marks], int | None]]] = {
    b"RIFF": ("audio/wav", riff),
    b"\x89PNG\r\n\x1a\n": ("image/png", png),
    b"GIF87a": ("image/gif", gif),
    b"GIF89a": ("image/gif", gif),
    b"\xff\xd8\xff": ("image/jpeg", jpeg),
    b"BM": ("image/bmp", bmp),
    b"\x1f\x8b\x08": ("application/gzip", gzip),
    b"%PDF-": ("application/pdf", pdf),
    b"PK\x03\x04": ("application/zip", zipped),
    b"OggS": ("audio/ogg", ogg),
}
_RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def signature_automaton() -> object:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for magic in SIGNATURES:
        automaton.add_word(magic.decode("latin-1"), magic)
    automaton.make_automaton()
    return automaton


def sniff(data: bytes, automaton: object) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every whole object whose magic bytes and structure are confirmed, nested ones too."""
    found, marks = [], Marks(data)
    for end, magic in automaton.iter(data.decode("latin-1")):
        kind, check = SIGNATURES[magic]
        at = end + 1 - len(magic)
        size = check(data, at, marks)
        if size:
            found.append((_RIFF_FORMS.get(data[at + 8 : at + 12], "application/riff") if magic == b"RIFF" else kind, at, size))
    return found


# ---------------------------------------------------------------- payloads as 8-bit audio


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % BLOCK if payload else BLOCK)


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit PCM; the samples are the bytes."""
    pad = bytes(len(samples) & 1)
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def wav_samples(data: bytes) -> bytes:
    pos = 12
    while pos + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, pos)
        if kind == b"data":
            return data[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def store(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, declared, media: the padded UTF-8 bytes as a WAV object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([DECLARED] * len(raw)), pa.array([wav(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "declared", "media"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def inspect(table: DataFrame) -> DataFrame:
    """table(declared, media, other columns stay) with detected (the confirmed type at offset 0, else the declared
    one), corrected (it differs), objects (whole objects embedded further on: type, at, length), media_bytes and
    media_sha256.  A null media has its declared type, no objects and null length and digest."""
    table = table.drop("detected", "corrected", "objects", "media_bytes", "media_sha256")
    objects = "array<struct<type:string,at:long,length:long>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + f", detected string, corrected boolean, objects {objects}, media_bytes long, media_sha256 string"
    inner = pa.list_(pa.struct([("type", pa.string()), ("at", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = signature_automaton()
        for batch in batches:
            kinds, fixed, lists, sizes, digests = [], [], [], [], []
            for declared, media in zip(batch.column("declared").to_pylist(), batch.column("media").to_pylist(), strict=True):
                found = sniff(media, automaton) if media is not None else []
                kind = next((k for k, at, _ in found if at == 0), declared)
                kinds.append(kind)
                fixed.append(kind != declared)
                lists.append([{"type": k, "at": at, "length": n} for k, at, n in found if at])
                sizes.append(None if media is None else len(media))
                digests.append(None if media is None else hashlib.sha256(media).hexdigest())
            more = [pa.array(kinds, pa.string()), pa.array(fixed, pa.bool_()), pa.array(lists, inner), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "detected", "corrected", "objects", "media_bytes", "media_sha256"])

    return table.mapInArrow(run, schema)


def carve(inspected: DataFrame) -> DataFrame:
    """A row per embedded object of an inspected table: its columns but media, and type, at, length, object (its bytes)."""
    kept = [c for c in inspected.columns if c not in ("media", "objects")]
    rows = inspected.select(*kept, "media", F.explode("objects").alias("o"))
    return rows.select(*kept, "o.type", "o.at", "o.length", F.substring("media", F.col("o.at").cast("int") + 1, F.col("o.length").cast("int")).alias("object"))


def features(docs: DataFrame) -> DataFrame:
    """Store every text of docs(doc_id, text), read the stored bytes back, inspect and describe them.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, feature.  A null or empty text is 64 zero bytes; equal texts have equal values.  Rows
    stay in their partitions; the stored table is in the shared folder.
    """
    kept = written(store(docs), "media")
    seen = inspect(kept)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, tails, texts = [], [], [], []
            cols = (batch.column(c).to_pylist() for c in ("media", "declared", "detected", "corrected", "objects"))
            for media, declared, detected, corrected, objects in zip(*cols, strict=True):
                data = wav_samples(media)
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
                tails.append(zlib.crc32(data[-BLOCK:]))
                x = np.frombuffer(data, np.uint8)
                held = np.bincount(x, minlength=256)
                share = held[held > 0] / len(x)
                carved = "+".join(f"{o['type']}@{o['at']}:{o['length']}" for o in objects)
                turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                texts.append(f"declared={declared};type={detected};corrected={int(corrected)};carved={carved};mean={x.mean():.6f};entropy={max(0.0, float(-(share * np.log2(share)).sum())):.6f};crossings={turns}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(tails, pa.int64()), batch.column("media_bytes"), batch.column("media_sha256"), pa.array(texts)], names)

    return seen.mapInArrow(run, schema)
