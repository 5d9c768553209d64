"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel edit distance."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fresh_path, held
from .files import Input, Output

#: Characters of test items in one automaton, some 60 MB in each worker, and bytes of texts that are searched with one before the next.
BLOCK_CHARS, HELD_BYTES = 1_000_000, 64 << 20
_APART = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, everything but letters and digits to single spaces, with one before and after; empty without any."""
    words = _APART.sub(" ", text.lower()).strip() if text else ""
    return f" {words} " if words else ""


def budget(item: str, error: float) -> int:
    """Edits allowed for a normalised item: a share of its characters without the spaces around it."""
    return int((len(item) - 2) * error)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces (offset, text) of nearly equal length; a match within the budget leaves one of them whole."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def least_distance(pattern: str, text: str) -> int:
    """The least edit distance of the pattern to any substring of the text."""
    m = len(pattern)
    if not m:
        return 0
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = mask, 0, m, m
    for c in text:
        e = equal.get(c, 0)
        v = e | minus
        h = (((e & plus) + plus) ^ plus) | e
        up, down = minus | ~(h | plus) & mask, plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = down | ~(v | up) & mask, up & v
    return best


class Finder:
    """Finds items within their error budget in normalised texts; an id may stand for several texts, and be null."""

    def __init__(self, items: list[tuple[int | None, str]], error: float):
        import ahocorasick

        ids: dict[str, dict[int | None, None]] = {}
        for i, t in items:
            ids.setdefault(t, {})[i] = None
        #: By place: a distinct text, its budget and the ids that it has.
        self.items = [(t, budget(t, error)) for t in ids]
        self.ids = [tuple(x) for x in ids.values()]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (t, k) in enumerate(self.items):
            for off, piece in pieces(t, k):
                found.setdefault(piece, []).append((i, off))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int | None, int]:
        """Item id -> the least distance of its texts, for the texts within budget."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, off in places:
                item, k = self.items[i]
                lo = max(0, end + 1 - size - off - k)
                hi = end + 1 - size - off + len(item) + k
                spans = windows.setdefault(i, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], hi)
                elif not spans or [lo, hi] != spans[-1]:
                    spans.append([lo, hi])
        out: dict[int | None, int] = {}
        for i, spans in windows.items():
            item, k = self.items[i]
            best = k + 1
            for lo, hi in spans:
                if text.find(item, lo, hi) >= 0:
                    best = 0
                elif best:
                    best = min(best, least_distance(item, text[lo:hi]))
                if not best:
                    break
            if best <= k:
                for x in self.ids[i]:
                    out[x] = min(best, out.get(x, best))
        return out


def _prepared(items: DataFrame, n_blocks: int) -> list[str]:
    """The items of each block as a file in the shared folder; a task makes one block."""
    folder = fresh_path(items.sparkSession, "benchmark")

    def make(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        kept = [(i, t) for i, text in zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True) if (t := normal(text))]
        if not kept:
            return pa.table({"path": pa.array([], pa.string())})
        out = Output(f"{folder}/{block:06d}.items")
        out.write(pickle.dumps(kept))
        out.close()
        return pa.table({"path": [f"{folder}/{block:06d}.items"]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    return sorted(r.path for r in dealt.groupBy("block").applyInArrow(make, "path string").collect())


def _opened(path: str, error: float) -> Finder:
    with Input(path) as f:
        return Finder(pickle.loads(f.at(0, f.size)), error)


def contamination(docs: DataFrame, benchmark: DataFrame, error: float = 0.05, block_chars: int = BLOCK_CHARS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """docs(doc_id, text) against benchmark(item_id, text): doc_id, n_items, item_ids, min_distance, contaminated.

    An item is in a document if some part of the document's normalised text is within error * length
    edits of the normalised item, both with the spaces around their words, so a short item isn't found
    inside a longer word: exact for any place, found by the pigeonhole principle, with no cap on candidates.  Null or empty texts match nothing (n_items 0, min_distance null).  An id may stand for
    several texts and counts once; items with a null id count as one id, a null at the end of item_ids.  Rows stay as they
    are, repeated ones too; other columns of docs are left out.

    Items lie in blocks of about `block_chars` in the shared folder.  One pass goes over the documents, with one Python worker a
    task whatever the number of blocks: it normalises `held_bytes` of texts, searches them with one block's automaton after
    another, and goes on to the next texts.  With a single block a worker keeps its automaton from task to task.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").dropDuplicates()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    paths = _prepared(items, max(1, -(-int(total) // block_chars)))

    def searched(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [[normal(t) for t in b.column(1).to_pylist()] for b in rows]
        found: list[list[dict[int | None, int]]] = [[{} for _ in t] for t in texts]
        for path in paths:
            finder = held("decontaminate", path, lambda path=path: _opened(path, error))
            for some, out in zip(texts, found, strict=True):
                for n, text in enumerate(some):
                    if text:
                        for i, d in finder.find(text).items():
                            out[n][i] = min(d, out[n].get(i, d))
        for b, out in zip(rows, found, strict=True):
            ids = [sorted(x, key=lambda i: (i is None, i or 0)) for x in out]
            least = [min(x.values()) if x else None for x in out]
            columns = [b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(least, pa.int64()), pa.array(map(bool, ids))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_items", "item_ids", "min_distance", "contaminated"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            rows.append(batch)
            size += batch.nbytes
            if size >= held_bytes or len(paths) < 2:
                yield from searched(rows)
                rows, size = [], 0
        yield from searched(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_items long, item_ids array<long>, min_distance long, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, error: float = 0.05) -> DataFrame:
    """The documents without any benchmark item, with all their columns; a row with a null doc_id is judged by its text too."""
    found = contamination(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), benchmark, error)
    return found.where("not contaminated").select(*(F.col("doc_id").getField(c).alias(c) for c in docs.columns))
