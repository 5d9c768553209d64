"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Files of the model, in the shared folder, by ranges (their numbers are in their names, so no list of them is kept):
  words    sorted 64-bit word hashes and their counts, by ranges of the hash; a word's id is its range and its place there
  stats    five counts for each word: predecessors, and as a context: tokens, successors seen once, twice, more
  bigrams  sorted 64-bit hashes of (context id, word id) and their counts, by ranges of a hash of the context
Tasks combine what they count before the shuffle, in packed sorted arrays, so a hot word is a few entries; a task
sends a range one blob at most, and never more blobs than it has entries.  Two of a billion bigrams share a hash with
a chance of 3 %, of which one count would be off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, fresh_path, held, mix64, text_slices, word_bounds, word_hashes, written
from .files import Output, mapped

END, BEGIN = U64(0x517CC1B727220A95), U64(0x2545F4914F6CDD1D)
#: Tokens of the input for each range of a reduce, and entries that a task holds before it sends them.
RANGE_TOKENS, HELD = 3_000_000, 1_500_000
#: A context with more tokens than this has its successors dealt over all ranges.
HOT_CONTEXT = 500_000
SLICE = 1 << 20
_SHIFT = U64(32)


def _planes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def pack(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending 64-bit keys as deltas, then 64-bit ids if unsigned and counts if signed, in byte planes."""
    delta = np.diff(keys, prepend=U64(0)) if len(keys) else keys
    return zstandard.ZstdCompressor(level=1).compress(b"".join([_planes(delta, "<u8"), *(_planes(c, "<u8" if c.dtype == np.uint64 else "<u4") for c in more)]))


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """kinds: k for the keys, i for each array of ids, c for each of counts."""
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    width = [4 if k == "c" else 8 for k in kinds]
    n, out, at = len(raw) // sum(width), [], 0
    for k, w in zip(kinds, width, strict=True):
        x = np.ascontiguousarray(raw[at : at + w * n].reshape(w, n).T).view(f"<u{w}").ravel()
        out.append(np.cumsum(x, dtype=U64) if k == "k" else x)
        at += w * n
    return out


def summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct ascending keys with their counts added up."""
    if not len(keys):
        return [keys, *(c.astype(np.int64) for c in counts)]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(c[order].astype(np.int64), first) for c in counts)]


def _merged(blobs: list[bytes], n_counts: int) -> list[np.ndarray]:
    parts = [unpack(b, "k" + "c" * n_counts) for b in blobs]
    return summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _store(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Each array as one file of plain little-endian numbers."""
    for i, a in enumerate(arrays):
        out = Output(f"{folder}/{name}.{i}")
        out.write(np.ascontiguousarray(a).tobytes())
        out.close()


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and END after them, and the number of tokens of each."""
    starts, ends, at = word_bounds(data, off)
    return np.insert(word_hashes(data, starts, ends), at[1:], END), np.diff(at) + 1


def word_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


class Words:
    """Ids and counts of words, from the mapped files."""

    def __init__(self, folder: str, ranges: int):
        self.folder, self.ranges, self.open = folder, ranges, {}

    def find(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each of ascending hashes is known, its id and its count."""
        known, ids, counts = np.zeros(len(sorted_hashes), bool), np.zeros(len(sorted_hashes), U64), np.zeros(len(sorted_hashes), np.int64)
        at = word_range(sorted_hashes, self.ranges)
        for r in np.unique(at).tolist():
            lo, hi = np.searchsorted(at, r), np.searchsorted(at, r, side="right")
            if r not in self.open:
                self.open[r] = mapped(f"{self.folder}/words-{r}.0", "<u8"), mapped(f"{self.folder}/words-{r}.1", "<u8")
            keys, n = self.open[r]
            if not len(keys):
                continue
            place = np.minimum(np.searchsorted(keys, sorted_hashes[lo:hi]), len(keys) - 1)
            hit = keys[place] == sorted_hashes[lo:hi]
            known[lo:hi] = hit
            ids[lo:hi][hit] = place[hit].astype(U64) | U64(r) << _SHIFT
            counts[lo:hi][hit] = n[place[hit]].astype(np.int64)
        return known, ids, counts


def bigram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(context + U64(1)) * U64(0x9E3779B97F4A7C15) + word)


def bigram_range(context: np.ndarray, key: np.ndarray, hot: np.ndarray, ranges: int) -> np.ndarray:
    return word_range(mix64(np.where(hot, key, context) ^ U64(0x9FB21C651E98DF25)), ranges)


@dataclass
class Model:
    """What a scoring task needs: a folder and totals, no counts of the corpus."""

    folder: str
    ranges: int
    n_tokens: int
    n_words: int
    keep: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    pairs: int
    spare: float
    begin_hot: bool

    @property
    def begin(self) -> np.uint64:
        """The id of the context before the first word: alone in a range of its own."""
        return U64(self.ranges) << _SHIFT


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts 1 to 4; 0.75 where they tell nothing."""
    if not n[0] or not n[1]:
        return 0.75, 0.75, 0.75
    y = n[0] / (n[0] + 2 * n[1])
    out = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.75 for i in range(3)]
    return tuple(min(max(d, 0.0), float(i + 1)) for i, d in enumerate(out))


def discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _reduce_groups(rows: DataFrame, key: str, schema: str, work) -> DataFrame:
    """applyInArrow by key over rows(key long, blob binary); work(key, blobs) returns the columns of schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        cols = work(table.column(key)[0].as_py(), table.column("blob").to_pylist())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return rows.groupBy(key).applyInArrow(run, schema)


def train(docs: DataFrame, keep: int = 1) -> Model:
    """Count docs(text) and write the model.  keep prunes, and is off by default: bigrams seen fewer than
    keep times aren't stored and their whole mass goes to the lower order, so probabilities still add up to
    one.  Null texts are empty (an END only); no rows give the uniform model; other columns are ignored."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    folder = fresh_path(spark, "ngrams")
    size = docs.agg(F.sum(F.octet_length("text") / 6 + 1).alias("n"), F.count("*").alias("rows")).first()
    ranges = max(1, int((size.n or 0) / RANGE_TOKENS) + 1)
    begin, begin_hot = U64(ranges) << _SHIFT, size.rows > HOT_CONTEXT

    def by_range(at: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        """Blobs of the ranges of entries that are sorted by range."""
        cuts = np.searchsorted(at, np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        return pa.RecordBatch.from_pydict({"range": pa.array(some, pa.int64()), "blob": pa.array([pack(*(c[cuts[r] : cuts[r + 1]] for c in columns)) for r in some], pa.binary())})

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            return by_range(word_range(keys, ranges), keys, counts)

        for batch in batches:
            for _, data, off in text_slices(batch.column(0), SLICE):
                hashes, _ = tokens(data, off)
                parts.append(np.unique(hashes, return_counts=True))
                n += len(parts[-1][0])
                if n > HELD:
                    yield flush()
                    parts, n = [], 0
        if parts:
            yield flush()

    def store_words(r: int, blobs: list[bytes]) -> list[list]:
        keys, counts = _merged(blobs, 1)
        _store(folder, f"words-{r}", keys.astype("<u8"), counts.astype("<u8"))
        return [[r], [len(keys)], [int(counts.sum())]]

    counted = docs.mapInArrow(count_words, "range long, blob binary")
    stored = written(_reduce_groups(counted, "range", "range long, n long, total long", store_words), "words").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n_words, n_tokens = stored.n or 0, stored.total or 0

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, n = Words(folder, ranges), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts, context, word, hot = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
            counts, order = np.add.reduceat(counts[order], first), order[first]
            context, word, at = context[order], word[order], bigram_range(context[order], keys[order], hot[order], ranges)
            order = np.lexsort((context, at))
            return by_range(at[order], context[order], word[order], counts[order])

        for batch in batches:
            for _, data, off in text_slices(batch.column(0), SLICE):
                hashes, lengths = tokens(data, off)
                distinct, inverse = np.unique(hashes, return_inverse=True)
                _, ids, seen = words.find(distinct)
                context, hot = _contexts(ids[inverse], (seen > HOT_CONTEXT)[inverse], lengths, begin, begin_hot)
                word = ids[inverse]
                keys, first, counts = np.unique(bigram_key(context, word), return_index=True, return_counts=True)
                parts.append((keys, counts, context[first], word[first], hot[first]))
                n += len(keys)
                if n > HELD:
                    yield flush()
                    parts, n = [], 0
        if parts:
            yield flush()

    def store_bigrams(r: int, blobs: list[bytes]) -> list[list]:
        context, word, counts = (np.concatenate(c) for c in zip(*(unpack(b, "kic") for b in blobs), strict=True))
        keys = bigram_key(context, word)
        order = np.argsort(keys, kind="stable")
        keys, context, word = keys[order], context[order], word[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, context, word, counts = keys[first], context[first], word[first], np.add.reduceat(counts[order].astype(np.int64), first)
        kept = counts >= keep
        _store(folder, f"bigrams-{r}", keys[kept].astype("<u8"), counts[kept].astype("<u4"))
        as_word = summed(word, np.ones(len(keys), np.int64))
        as_context = summed(context, counts, counts == 1, counts == 2, counts >= 3)
        pad = np.zeros(len(as_word[0]), np.int64)
        stats = summed(np.concatenate([as_word[0], as_context[0]]), np.concatenate([as_word[1], np.zeros(len(as_context[0]), np.int64)]), *(np.concatenate([pad, c]) for c in as_context[1:]))
        place = stats[0] >> _SHIFT
        some = np.unique(place)
        cuts = np.append(np.searchsorted(place, some), len(place))
        packed = [pack(*(c[cuts[i] : cuts[i + 1]] for c in stats)) for i in range(len(some))]
        n = len(some)
        return [[-1, *some.tolist()], [None, *packed], *([int((counts == i).sum()), *[None] * n] for i in range(1, 5)), [len(keys), *[None] * n]]

    pairs = docs.mapInArrow(count_bigrams, "range long, blob binary")
    reduced = written(_reduce_groups(pairs, "range", "place long, blob binary, n1 long, n2 long, n3 long, n4 long, n long", store_bigrams), "bigrams")
    by_count = reduced.where("place = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "n"))).first()

    def store_stats(r: int, blobs: list[bytes]) -> list[list]:
        ids, *counts = _merged(blobs, 5)
        at = (ids & U64(0xFFFFFFFF)).astype(np.int64)
        table = np.zeros((int(at.max()) + 1, 5), "<u4")
        table[at] = np.stack(counts, axis=1)
        before = table[:, 0]
        _store(folder, f"stats-{r}", table)
        return [[r], *([int((before == i).sum())] for i in range(1, 5)), [int((before >= 3).sum())]]

    sums = _reduce_groups(reduced.where("place >= 0").select("place", "blob"), "place", "place long, n1 long, n2 long, n3 long, n4 long, more long", store_stats)
    stats = written(sums, "stats").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "more"))).first()
    d = discounts([stats.n1, stats.n2, stats.n3, stats.n4])
    spare = (d[0] * stats.n1 + d[1] * stats.n2 + d[2] * stats.more) / by_count.n if by_count.n else 1.0
    return Model(folder, ranges, n_tokens, n_words, keep, discounts([by_count.n1, by_count.n2, by_count.n3, by_count.n4]), d, by_count.n, spare, begin_hot)


def _contexts(ids: np.ndarray, hot: np.ndarray, lengths: np.ndarray, begin: np.uint64, begin_hot: bool) -> tuple[np.ndarray, np.ndarray]:
    """The id before each token (begin at the first of a text) and whether it is hot."""
    before, before_hot = np.roll(ids, 1), np.roll(hot, 1)
    first = np.cumsum(lengths) - lengths
    before[first], before_hot[first] = begin, begin_hot
    return before, before_hot


class Scorer:
    """log10 probabilities of token streams from the mapped files of a model."""

    def __init__(self, model: Model):
        self.m, self.words, self.open, self.stats = model, Words(model.folder, model.ranges), {}, {}

    def _stats(self, ids: np.ndarray) -> np.ndarray:
        """Rows of five counts for ids."""
        out = np.zeros((len(ids), 5), np.int64)
        order = np.argsort(ids, kind="stable")
        place = ids[order] >> _SHIFT
        for s in np.unique(place).tolist():
            mine = order[np.searchsorted(place, s) : np.searchsorted(place, s, side="right")]
            if s not in self.stats:
                self.stats[s] = mapped(f"{self.m.folder}/stats-{s}.0", "<u4").reshape(-1, 5)
            at = (ids[mine] & U64(0xFFFFFFFF)).astype(np.int64)
            there = at < len(self.stats[s])
            out[mine[there]] = self.stats[s][at[there]]
        return out

    def _bigrams(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Stored counts of distinct keys of the ranges `at`, 0 where none is stored."""
        out = np.zeros(len(keys), np.int64)
        order = np.argsort(at, kind="stable")
        for r in np.unique(at).tolist():
            mine = order[np.searchsorted(at[order], r) : np.searchsorted(at[order], r, side="right")]
            if r not in self.open:
                self.open[r] = mapped(f"{self.m.folder}/bigrams-{r}.0", "<u8"), mapped(f"{self.m.folder}/bigrams-{r}.1", "<u4")
            stored, counts = self.open[r]
            if len(stored):
                place = np.minimum(np.searchsorted(stored, keys[mine]), len(stored) - 1)
                hit = stored[place] == keys[mine]
                out[mine[hit]] = counts[place[hit]]
        return out

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: number of tokens, known tokens, base score and score."""
        m = self.m
        hashes, lengths = tokens(data, off)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        known, ids, seen = self.words.find(distinct)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        base = np.log10((seen + 0.5) / (m.n_tokens + 0.5 * (m.n_words + 1)))[inverse]
        stats = np.zeros((len(ids), 5), np.int64)
        stats[known] = self._stats(ids[known])
        pairs = max(1, m.pairs)
        lower = (stats[:, 0] - discount(stats[:, 0], m.word_discounts)) / pairs + m.spare / (m.n_words + 1)
        word, first = ids[inverse], np.cumsum(lengths) - lengths
        context, hot = _contexts(word, (seen > HOT_CONTEXT)[inverse], lengths, m.begin, m.begin_hot)
        as_context = np.zeros((len(word), 5), np.int64)
        as_context[1:] = stats[inverse[:-1]]
        as_context[first] = self._stats(np.array([m.begin]))[0]
        there = np.roll(known[inverse], 1)
        there[first] = True
        there &= known[inverse]
        both = np.zeros(len(word), np.int64)
        keys, at, back = np.unique(bigram_key(context[there], word[there]), return_index=True, return_inverse=True)
        both[there] = self._bigrams(keys, bigram_range(context[there][at], keys, hot[there][at], m.ranges))[back]
        total = as_context[:, 1]
        d = m.bigram_discounts
        cut = [d[i] if m.keep <= i + 1 else float(i + 1) for i in range(2)]
        spare = as_context[:, 2] * cut[0] + as_context[:, 3] * cut[1] + as_context[:, 4] * d[2]
        some = np.maximum(total, 1)
        p = np.where(total > 0, (both - discount(both, d)) / some + spare / some * lower[inverse], lower[inverse])
        add = lambda x: np.bincount(owner, weights=x, minlength=len(lengths))
        return lengths, add(known[inverse]).astype(np.int64), add(base), add(np.log10(p))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score; one pass, no shuffle.

    A null text is empty and is scored as its END.  Whole texts; repeated rows stay.
    """
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held("ngram", model.folder, lambda: Scorer(model))
        for batch in batches:
            for row, data, off in text_slices(batch.column(1), SLICE):
                n, known, base, own = scorer.score(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n), pa.array(known), pa.array(np.full(len(n), scorer.m.n_tokens)), pa.array(base), pa.array(own)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
