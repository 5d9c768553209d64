"""Token ids in bit-plane files.

A file holds blocks of a fixed number of 32-bit ids.  Each block is transposed into 4 byte planes (or
32 bit planes) and every plane is compressed with Zstandard.  The footer has the chunk index (offset
and plane lengths of each block) and the documents (doc_id, number of ids), then its own place.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import fresh_path, held, text_slices, word_bounds, word_hashes, written
from .files import Input, Output

MAGIC = b"TLPLANE1"
BLOCK_IDS = 1 << 16
NULL_ID = -(1 << 63)
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Pieces whose ids a worker keeps, in arrays of some 15 MB.
CACHE_WORDS = 400_000


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of 32-bit ids: 4 of bytes, or 32 of bits."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, i].tobytes() for i in range(4)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel()


class PlaneWriter:
    """Appends documents to one file; holds at most a block of ids and the index."""

    def __init__(self, uri: str, bits: bool = False, level: int = 3):
        self.uri, self.bits, self.out = uri, bits, Output(uri)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.out.write(MAGIC)
        self.held, self.n_held, self.blocks, self.docs, self.total = [], 0, [], [], 0

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs += zip(doc_ids, lengths.tolist(), strict=True)
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            ids = np.concatenate(self.held)
            cut = len(ids) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, cut, BLOCK_IDS):
                self._block(ids[i : i + BLOCK_IDS])
            self.held, self.n_held = [ids[cut:]], len(ids) - cut

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) for p in to_planes(ids, self.bits)]
        self.blocks.append((self.out.size, len(ids), [len(p) for p in packed]))
        for p in packed:
            self.out.write(p)

    def close(self) -> tuple[str, int, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        planes = 32 if self.bits else 4
        index = np.array([[o, n, *z] for o, n, z in self.blocks], "<u8").reshape(-1, 2 + planes)
        docs = np.array([(NULL_ID if d is None else d, n) for d, n in self.docs], "<i8").reshape(-1, 2)
        foot = self.zstd.compress(struct.pack("<IQQ", planes, len(index), len(docs)) + index.tobytes() + docs.tobytes())
        at = self.out.size
        self.out.write(foot + struct.pack("<QQI", at, len(foot), zlib.crc32(foot)) + MAGIC)
        self.out.close()
        return self.uri, len(self.docs), self.total


class PlaneReader:
    """Reads documents or any block of one file."""

    def __init__(self, uri: str):
        self.file = Input(uri)
        at, size, crc = struct.unpack("<QQI", self.file.at(self.file.size - 28, 20))
        foot = self.file.at(at, size)
        if self.file.at(self.file.size - 8, 8) != MAGIC or zlib.crc32(foot) != crc:
            raise ValueError(f"{uri} isn't whole")
        plain = zstandard.decompress(foot)
        self.planes, blocks, docs = struct.unpack_from("<IQQ", plain)
        n = blocks * (2 + self.planes)
        self.index = np.frombuffer(plain, "<u8", n, 20).reshape(blocks, 2 + self.planes)
        self.docs = np.frombuffer(plain, "<i8", 2 * docs, 20 + 8 * n).reshape(docs, 2)

    def block(self, i: int) -> np.ndarray:
        at, n, *sizes = self.index[i].tolist()
        raw, planes = self.file.at(at, sum(sizes)), []
        for z in sizes:
            planes.append(zstandard.decompress(raw[:z]))
            raw = raw[z:]
        return from_planes(planes, n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the order of the file; one block and one document are held."""
        held, i = np.zeros(0, np.uint32), 0
        for doc, n in self.docs.tolist():
            parts = [held]
            have = len(held)
            while have < n:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            ids = np.concatenate(parts) if len(parts) > 1 else held
            held = ids[n:]
            yield (None if doc == NULL_ID else doc), ids[:n]


#: 1 letters, 2 ASCII marks, 3 the apostrophe, 0 the rest and the marks of special tokens (no cut beside them).
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[[x for x in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)) if chr(x) not in "<|>"]] = 2
_CLASS[0x27] = 3


def piece_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As base.word_bounds, but words are also cut between a letter (A-Z, a-z, U+00C0 to U+00FF) and an ASCII mark
    after it, and between an ASCII mark other than the apostrophe and a letter after it."""
    starts, ends, at = word_bounds(data, off)
    if len(data) < 2:
        return starts, ends, at
    kind = _CLASS[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[latin], kind[latin + 1] = 1, 1
    cut = np.flatnonzero((kind[:-1] == 1) & (kind[1:] >= 2) | (kind[:-1] == 2) & (kind[1:] == 1)) + 1
    cut = cut[off[np.searchsorted(off, cut)] != cut]
    starts = np.sort(np.concatenate([starts, cut]), kind="stable")
    return starts, np.sort(np.concatenate([ends, cut]), kind="stable"), np.searchsorted(starts, off)


class WordEncoder:
    """Encodes texts by their pieces with a tokenizer that drops white space; known pieces come from a cache.

    Cutting there leaves the ids as they are for a tokenizer like word_bpe_49k, which lower-cases, never
    joins across white space and splits letters, digits and marks (but 's, 't and the like) before merging.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        """No piece is known: ascending hashes, the place of each, and by place its first id and number of ids."""
        self.keys, self.place, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.flat, self.starts, self.lengths, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and the number of each.  Words of letters are encoded in one text:
        each is one unit of the tokenizer, whose last id ends a word."""
        joined = self.tokenizer.encode(" ".join(words), add_special_tokens=False) if self.ends is not None else None
        if joined is not None:
            ids = np.array(joined.ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words):
                return ids, np.diff(stops, prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)

    def _learn(self, words: list[str]) -> np.ndarray:
        """Keep the ids of new words; their places."""
        plain = [_PLAIN.fullmatch(w) is not None for w in words]
        order = [i for i, p in enumerate(plain) if p] + [i for i, p in enumerate(plain) if not p]
        cut, parts = sum(plain), []
        for i in range(0, cut, 4096):
            parts.append(self._encoded([words[j] for j in order[i : min(cut, i + 4096)]]))
        if cut < len(words):
            found = [e.ids for e in self.tokenizer.encode_batch([words[j] for j in order[cut:]], add_special_tokens=False)]
            parts.append((np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)))
        ids, lengths = (np.concatenate(c) for c in zip(*parts, strict=True))
        n = self.n
        while n + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.size : self.size + len(ids)] = ids
        self.starts[n : n + len(words)], self.lengths[n : n + len(words)] = self.size + np.cumsum(lengths) - lengths, lengths
        self.size += len(ids)
        self.n += len(words)
        places = np.empty(len(words), np.int32)
        places[order] = np.arange(n, self.n)
        return places

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with end_id after it, and the number of ids of each."""
        starts, ends, stop = piece_bounds(data, off)
        hashes, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.n + len(hashes) > CACHE_WORDS:
            self._reset()
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != hashes
        if new.any():
            raw = data.tobytes()
            places = self._learn([raw[starts[i] : ends[i]].decode() for i in first[new].tolist()])
            self.keys, self.place = np.insert(self.keys, at[new], hashes[new]), np.insert(self.place, at[new], places)
            at = np.searchsorted(self.keys, hashes)
        place = self.place[at]
        word = place[inverse]
        # the end ids stand after the words of each text
        count = np.insert(self.lengths[word].astype(np.int64), stop[1:], 1)
        source = np.insert(self.starts[word].astype(np.int64), stop[1:], -1)
        begin = np.cumsum(count) - count
        where = np.repeat(source - begin, count) + np.arange(count.sum())
        is_end = np.repeat(source, count) < 0
        ids = np.where(is_end, np.uint32(end_id), self.flat[np.where(is_end, 0, where)])
        sums = np.concatenate([[0], np.cumsum(count)])
        stops = stop[1:] + np.arange(1, len(stop))
        return ids.astype(np.uint32), np.diff(sums[np.concatenate([[0], stops])])


def encoder_for(path: str) -> WordEncoder:
    """The encoder of this worker process; its cache serves task after task."""
    return held("tokens", path, lambda: WordEncoder(path))


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, bits: bool = False) -> DataFrame:
    """Write docs(doc_id, text) in ascending doc_id order; one row per file: shard, path, n_docs, n_tokens.

    A null text is empty and has its end id only; null doc_ids come first; rows with the same doc_id (many
    nulls, say) are ordered by a hash of their text, which deals them to several files.  Other columns are left out.  Tasks name their files in their result, as in warc.write_bundles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("place", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = None, None
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for row, data, off in text_slices(batch.column(1)):
                if writer is None:
                    encoder, writer = encoder_for(tokenizer_path), PlaneWriter(f"{folder}/{shard:06d}-{uuid.uuid4().hex}.planes", bits)
                ids, lengths = encoder.encode(data, off, end_id)
                writer.add(batch.column(0).slice(row, len(lengths)).to_pylist(), lengths, ids)
        if writer is not None:
            path, n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return written(ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "token-files")


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it over all files), n_tokens, ids_crc32, shard, row in it, ids if asked."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("shard", "path", "n_tokens").withColumn("base", before)  # a row per file
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, row long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
        for batch in batches:
            for shard, uri, base in zip(*(batch.column(n).to_pylist() for n in ("shard", "path", "base")), strict=True):
                rows = []
                for row, (doc, ids) in enumerate(PlaneReader(uri).documents()):
                    rows.append((doc, base, len(ids), zlib.crc32(ids.tobytes()), shard, row, *([ids.tolist()] if with_ids else [])))
                    base += len(ids)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = placed.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    return read_tokens(write_tokens(docs, fresh_path(docs.sparkSession, "tokens"), tokenizer_path, end_id))
