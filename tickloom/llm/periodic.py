"""Runs of words that repeat with a period, and texts without the repeats.

A run of period q is a stretch of consecutive words in which words q apart are identical, that no
neighbour extends, whose smallest period is q and that has at least `MIN_POWER` periods and `MIN_WORDS` words.

Periods go by octaves [2**k, 2**(k+1)).  Octave k has a boundary after every 3 * 2**k words, so each of its
runs holds one with a whole period after it, and a tile of 8 * 2**k words around it.  In a tile the Z-functions of
the boundary, forwards and backwards, say for each period of the octave how far the words on both
sides agree with those a period on; that is a fragment [start, stop) of places i with word[i] = word[i + q].
Fragments are shuffled by document and period and stitched where they meet.

A document of up to `CHUNK_WORDS` words is solved where it is read, tiles of all octaves at once.  A longer one is
exploded: chunks with the tiles of the octaves below `HIGH`, and one row for each tile above, dealt over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import U64, mix64, text_slices, word_bounds, word_hashes, written

MIN_WORDS, MIN_POWER = 6, 4
#: Words of a chunk of a long document, and the first octave whose tiles are rows of their own.
CHUNK_WORDS, HIGH = 1 << 15, 10
#: Places of words that one comparison of fragments holds.
_AT_ONCE = 1 << 21
_K = U64(0xD6E8FEB86659FD93)
_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


@lru_cache(maxsize=2)
def _least_factors(n: int) -> np.ndarray:
    """The least prime factor of each number below n."""
    least = np.arange(n, dtype=np.int32)
    for p in range(2, int(n**0.5) + 1):
        if least[p] == p:
            part = least[p * p :: p]
            part[part == np.arange(p * p, n, p, dtype=np.int32)] = p
    return least


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of blocks of twice the size from those of blocks of that size; equal blocks have equal names."""
    if len(names) <= size:
        return names[:0]
    return mix64(names[:-size] * _K + names[size:])


def _same(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the blocks at a and b are there and equal (b is the later one)."""
    inside = (a >= 0) & (b < len(names))
    return inside & (names[np.where(inside, a, 0)] == names[np.where(inside, b, 0)]) if len(names) else np.zeros(len(a), bool)


def _primitive(names: np.ndarray, at: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """Whether the q words from each place aren't a repeated shorter part.  names: of blocks of half the octave."""
    out = np.ones(len(q), bool)
    half = size // 2
    least, rest = _least_factors(2 * size), q.copy()
    while half and (rest > 1).any():
        p = np.where(rest > 1, least[rest], 1)
        more = (p > 1) & out
        d = q // p
        equal = more.copy()
        for j in range(4):
            off = np.minimum(j * half, q - d - half)
            equal[more] &= _same(names, (at + off)[more], (at + d + off)[more])
        out &= ~equal
        rest = np.where(p > 1, rest // p, 1)
    return out


def _reach(words: np.ndarray, at: np.ndarray, q: np.ndarray, most: int, step: int) -> np.ndarray:
    """Z-values of boundaries for shifts q: how many places from `at` on (step 1) or before it (step -1) have the word that is q
    on; at most `most`."""
    out = np.zeros(len(at), np.int64)
    rows = max(1, _AT_ONCE // most)
    far = np.arange(most) if step > 0 else -1 - np.arange(most)
    for i in range(0, len(at), rows):
        place = at[i : i + rows, None] + far
        later = place + q[i : i + rows, None]
        inside = (place >= 0) & (later < len(words))
        same = inside & (words[np.where(inside, place, 0)] == words[np.where(inside, later, 0)])
        out[i : i + rows] = np.where(same.all(axis=1), most, same.argmin(axis=1))
    return out


def fragments(words: np.ndarray, octaves: range, origin: int = 0, first: int = 0, last: int | None = None) -> _Found:
    """(period, start, stop) around the boundaries in [first, last) of words that begin at place `origin` of their text.

    Only periods whose Z-values come to one and a half periods on one side matter: a run has three on both together.  Names of
    blocks (equal by a 64-bit hash) find those shifts without walking; the Z-values themselves compare words.
    """
    last = origin + len(words) if last is None else last
    found: list[_Found] = []
    names, half_names = words, words[:0]
    for k in range(octaves.stop):
        size = 1 << k
        if k:
            half_names, names = names, _doubled(names, size // 2)
        if not len(names):
            break
        if k < octaves.start:
            continue
        stride = 3 * size
        b = np.arange(-(-first // stride) * stride, last, stride) - origin
        padded = np.concatenate([names, np.zeros(3 * size, U64)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, size)
        at_all, q_all = [], []
        for back in (0, size):  # blocks after the boundary, blocks before it
            b_in = b[(b - back >= 0) & (b - back + size < len(names))]
            bi, qi = np.nonzero(windows[b_in - back + size] == names[b_in - back][:, None])
            at, q = b_in[bi], qi + size
            for most in (size, 2 * size):  # one and a half periods are three blocks that overlap
                off = np.minimum(most, (3 * q + 1) // 2 - size)
                place = at - size - off if back else at + off
                keep = _same(names, place, place + q)
                at, q = at[keep], q[keep]
            at_all.append(at)
            q_all.append(q)
        both = np.unique(np.concatenate(at_all) * (2 * size) + np.concatenate(q_all))
        at, q = both // (2 * size), both % (2 * size)
        keep = _primitive(half_names, at, q, size)
        at, q = at[keep], q[keep]
        if len(at):
            found.append((q, at - _reach(words, at, q, stride, -1) + origin, at + _reach(words, at, q, stride, 1) + origin))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def stitched(q: np.ndarray, start: np.ndarray, stop: np.ndarray) -> _Found:
    """Fragments of equal period that overlap or touch become one."""
    if not len(q):
        return q, start, stop
    order = np.lexsort((start, q))
    q, start, stop = q[order], start[order], stop[order]
    wide = int(stop.max()) + 2
    top = np.maximum.accumulate(q * wide + stop)
    new = np.concatenate([[True], (q * wide + start)[1:] > top[:-1]])
    heads = np.flatnonzero(new)
    return q[heads], start[heads], (top - q * wide)[np.append(heads[1:], len(q)) - 1]


def _long_enough(q: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return stop - start >= np.maximum(MIN_WORDS - q, (MIN_POWER - 1) * q)


def _short_documents(words: np.ndarray, at: np.ndarray, most: int = CHUNK_WORDS) -> tuple[np.ndarray, _Found]:
    """Stitched fragments of documents of one slice, and the document of each: those of like length laid end to end, with words between
    them that are equal to none, so that one pass does the tiles of all."""
    n = np.diff(at)
    kind = np.where((n >= MIN_WORDS) & (n <= most), np.frexp(np.maximum(n, 1).astype(float))[1] - 1, -1)
    docs, out = [], []
    for c in np.unique(kind[kind >= 0]).tolist():
        which = np.flatnonzero(kind == c)
        sizes = n[which] + 1
        begin = np.cumsum(sizes) - sizes
        line = mix64(np.arange(sizes.sum(), dtype=U64) * _K + U64(c + 1))  # the words between
        inside = np.ones(len(line), bool)
        inside[begin + sizes - 1] = False
        line[inside] = words[_spread(at[which], n[which])]
        q, start, stop = stitched(*fragments(line, range(max(c - 1, 1))))
        keep = _long_enough(q, start, stop)
        q, start, stop = q[keep], start[keep], stop[keep]
        doc = np.searchsorted(begin, start, side="right") - 1
        docs.append(which[doc])
        out.append((q, start - begin[doc], stop - begin[doc]))
    if not docs:
        return np.zeros(0, np.int64), (np.zeros(0, np.int64),) * 3
    return np.concatenate(docs), tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1 ... of n[i] for each i, one after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


_FRAGMENT = pa.list_(pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
_SCANNED = "row long, n_words long, text string, fragments array<struct<period: bigint, start: bigint, stop: bigint>>, kept_sha256 string"


def _listed(docs: np.ndarray, found: _Found, n: int) -> pa.Array:
    order = np.argsort(docs, kind="stable")
    off = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays([pa.array(x[order], pa.int64()) for x in found], fields=list(_FRAGMENT.value_type)))


def _scan(texts: bool, most: int):
    """For each text the fragments of its words if it is short; texts go on only where they may lose words, or with `texts`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, text = batch.column(0), batch.column(1)
            for i, data, off in text_slices(text):
                starts, ends, at = word_bounds(data, off)
                words = word_hashes(data, starts, ends, lower=False)
                docs, found = _short_documents(words, at, most)
                n = np.diff(at)
                marked = n > most
                marked[docs] = True
                raw = [data[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                sha = [None if m else hashlib.sha256(b" ".join(x.split())).hexdigest() for m, x in zip(marked.tolist(), raw, strict=True)]
                goes = pa.array([x if m or texts else None for m, x in zip(marked.tolist(), raw, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([row.slice(i, len(n)), pa.array(n, pa.int64()), goes, _listed(docs, found, len(n)), pa.array(sha, pa.string())], names=["row", "n_words", "text", "fragments", "kept_sha256"])

    return task


_TILE = "row long, low int, high int, origin long, first long, last long, words binary"


def _tiles(chunk: int, apart: int):
    """Explode long documents into chunks with the octaves below `apart` and tiles for each octave from it on."""

    def spans(n: int) -> list[tuple[int, int, int, int, int, int]]:
        side = 3 << (apart - 1)  # a stride of the last low octave; its periods add two thirds of that
        out = [(0, apart, a - side, a, min(a + chunk, n), a + chunk + 2 * side) for a in range(0, n, chunk)]
        k = apart
        while MIN_POWER << k <= n:
            out += [(k, k + 1, b - (3 << k), b, b + 1, b + (5 << k)) for b in range(0, n, 3 << k)]
            k += 1
        return out

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "low", "high", "origin", "first", "last", "words"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for i, data, off in text_slices(batch.column(1)):
                starts, ends, at = word_bounds(data, off)
                words = word_hashes(data, starts, ends, lower=False)
                for j in range(len(off) - 1):
                    own = words[at[j] : at[j + 1]]
                    row, n = batch.column(0)[i + j].as_py(), len(own)
                    for low, high, a, first, last, b in spans(n):
                        a, b = max(a, 0), min(b, n)
                        values = (row, low, high, a, first, last, own[a:b].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    return task


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of tiles: whole ones if they are long enough, and all that another tile may go on with."""
    for batch in batches:
        for t in batch.to_pylist():
            q, start, stop = stitched(*fragments(np.frombuffer(t["words"], U64), range(t["low"], t["high"]), t["origin"], t["first"], t["last"]))
            keep = _long_enough(q, start, stop) | (start <= t["first"]) | (stop >= t["last"])
            columns = [np.full(keep.sum(), t["row"]), q[keep], start[keep], stop[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["row", "period", "start", "stop"])


_KEPT = "row long, n_words long, runs array<struct<start: bigint, period: bigint, length: bigint>>, kept_text string, kept_sha256 string"


def _collapse(texts: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sha = [], []
            text, runs = batch.column(2), batch.column(3)
            for i in range(len(batch)):
                words = text[i].as_py().encode().split()
                x = runs[i].values
                if x is not None and len(x):
                    start, period, length = (x.field(c).to_numpy() for c in ("start", "period", "length"))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start + period, 1)
                    np.add.at(edge, start + length, -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                joined = b" ".join(words)
                kept.append(joined.decode() if texts else None)
                sha.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), runs, pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=["row", "n_words", "runs", "kept_text", "kept_sha256"])

    return task


def stitched_runs(fragments_of_rows: DataFrame) -> DataFrame:
    """Runs (row, start, period, length) from fragments (row, period, start, stop), which are shuffled by row and period."""
    w = Window.partitionBy("row", "period").orderBy("start")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        fragments_of_rows.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
        .groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    length = F.col("stop") - F.col("start") + F.col("period")
    return runs.select("row", "start", "period", length.alias("length")).where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_POWER * F.col("period")))


def collapse(df: DataFrame, text: str = "text", texts: bool = True, chunk: int = CHUNK_WORDS, apart: int = HIGH) -> DataFrame:
    """The runs of each text and the text without their repeats.

    Adds to df: n_words, runs (start, period and length, by start and then period), kept_text (the words in no
    run after its first period, joined by one space; null unless `texts`) and kept_sha256 (of kept_text).  Columns of df with these
    names are replaced; others stay.  A null, empty or blank text has no words, no runs and an empty kept_text.  Rows are
    told apart by their place, so repeated rows and null ids each get their own result; an empty table gives
    an empty table.  Words are compared by 64-bit hashes.  `chunk` and `apart` only say how documents are dealt.
    """
    own = ("n_words", "runs", "kept_text", "kept_sha256", "row", "fragments")
    others = [c for c in df.columns if c not in own and c != text]
    base = df.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), F.struct(*(F.col(c) for c in others)).alias("given") if others else F.lit(None).cast("string").alias("given"))
    scanned = written(_with_given(base, _scan(texts, chunk), _SCANNED), "periodic-scan")
    tiles = scanned.where(F.col("n_words") > chunk).select("row", "text").mapInArrow(_tiles(chunk, apart), _TILE)
    far = tiles.repartition("row", "low", "first").mapInArrow(_solve, "row long, period long, start long, stop long")
    runs = stitched_runs(scanned.select("row", F.inline("fragments")).unionByName(far))
    listed = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast("array<struct<start: bigint, period: bigint, length: bigint>>")
    marked = scanned.where("kept_sha256 is null").join(listed, "row", "left").select("row", "n_words", "text", F.coalesce("runs", none).alias("runs"), "given")
    changed = _with_given(marked, _collapse(texts), _KEPT)
    joined = F.concat_ws(" ", F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")) if texts else F.lit(None).cast("string")
    plain = scanned.where("kept_sha256 is not null").select("n_words", none.alias("runs"), joined.alias("kept_text"), "kept_sha256", "given")
    out = changed.drop("row").unionByName(plain)
    return out.select(*(F.col("given").getField(c).alias(c) for c in others), "n_words", "runs", "kept_text", "kept_sha256")


def _with_given(df: DataFrame, task, schema: str) -> DataFrame:
    """mapInArrow of the other columns, with column `given`, the last, carried along row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, done = batch.column(len(batch.schema) - 1), 0
            for out in task(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, given.slice(done, len(out))], names=[*out.schema.names, "given"])
                done += len(out)

    return df.mapInArrow(run, f"{schema}, given {df.schema['given'].dataType.simpleString()}")


def exceeds(a, b):
    """Whether run a has a greater length for its period than run b, exactly."""
    return a["length"] * b["period"] > b["length"] * a["period"]


def strongest(runs: str):
    """The run of greatest exact length over period, the first of equal ones in the list; null without runs."""
    return F.aggregate(F.slice(F.col(runs), 2, F.greatest(F.size(runs), F.lit(1))), F.get(F.col(runs), F.lit(0)), lambda best, x: F.when(exceeds(x, best), x).otherwise(best))
