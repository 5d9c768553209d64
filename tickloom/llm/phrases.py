"""Collocations: phrases of 2 and 3 words that hold together, counted on a prefix-free parse.

Texts are cut where their content says so: before a word whose hash is 0 modulo `TRIGGER`.  Every chunk goes on for the next two
words of its piece, so each phrase lies whole in the chunk that it starts in and is counted there only.  The
distinct chunks with their frequencies are the dictionary; copies of texts parse into the same chunks.  Phrases are counted
inside distinct chunks, weighted by frequency, in three steps over pages of the dictionary:

1. Each page sends 48-bit hashes of its words and pairs with counts, dealt by ranges of the hash.
2. Whoever adds a range up tells each page which of the hashes it sent are frequent (at least `least`; a collision can only
   add hashes).
3. Each page sends words, pairs and triples of frequent pairs (no other triple can be frequent) as text with
   counts, which are added up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import _LOWER, U64, mix64, text_slices, word_bounds, word_hashes, written

#: One word of so many ends a chunk, on average; no chunk has more words of its own than MOST_WORDS.
TRIGGER, MOST_WORDS = 8, 64
#: Bytes of a page of the dictionary, and words of the dictionary for one task that adds up.
PAGE_BYTES, WORDS_A_TASK = 4 << 20, 2 << 20
BITS = 48
_K1, _K2 = U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _strings(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The byte ranges as a string array; they may overlap."""
    n = last - first
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(off), pa.py_buffer(data[_spread(first, n)].tobytes()))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, chunk, tail) of every chunk: lower-cased words joined by one space, and how many at its end belong to the next chunk."""
    for batch in batches:
        for row, data, off in text_slices(batch.column(1)):
            if not len(data):
                continue
            inside = _WORD[data]
            edge = np.zeros(len(data), bool)
            edge[off[:-1][off[:-1] < len(data)]] = True
            before = np.concatenate([[False], inside[:-1]]) & ~edge
            starts = np.flatnonzero(inside & ~before)
            if not len(starts):
                continue
            after = np.concatenate([inside[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
            ends = np.flatnonzero(inside & ~after) + 1
            text = np.searchsorted(off, starts, side="right") - 1
            breaks = np.cumsum(_BREAK[data])[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
            place = np.arange(len(starts))
            cut = new | (word_hashes(data, starts, ends) % U64(TRIGGER) == 0)
            cut |= (place - np.maximum.accumulate(np.where(cut, place, 0))) % MOST_WORDS == 0
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(starts))
            pieces = np.append(np.flatnonzero(new), len(starts))
            stop = pieces[np.searchsorted(pieces, first, side="right")]
            tail = np.minimum(stop - last, 2)
            size = ends - starts + 1
            at = np.cumsum(size) - size
            line = _LOWER[data[np.minimum(_spread(starts, size), len(data) - 1)]]
            line[at + size - 1] = 0x20
            past = last + tail - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row + text[first])), _strings(line, at[first], at[past] + size[past] - 1), pa.array(tail, pa.int32())], names=["lang", "chunk", "tail"]
            )


_PAGE = "page long, words long, lang array<string>, chunk array<string>, tail array<int>, n array<bigint>"


def _pages(most: int):
    """Pack rows of the dictionary into pages of about `most` bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def page() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            words = pc.sum(pc.count_substring(table["chunk"], " ")).as_py() + len(table)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table[c].combine_chunks()) for c in ("lang", "chunk", "tail", "n")]
            return pa.RecordBatch.from_arrays([pa.array([part + seq]), pa.array([words]), *lists], names=["page", "words", "lang", "chunk", "tail", "n"])

        for batch in batches:
            for i in range(0, len(batch), 4096):
                held.append(batch.slice(i, 4096))
                size += pc.sum(pc.binary_length(held[-1].column(1))).as_py()
                if size >= most:
                    yield page()
                    seq, held, size = seq + 1, [], 0
        if sum(map(len, held)):
            yield page()

    return task


class _Page:
    """The words of a page: places, hashes and how often each is counted."""

    def __init__(self, row: dict):
        self.langs, self.n = row["lang"], row["n"].to_numpy().astype(np.int64)
        chunk, tail = row["chunk"], row["tail"].to_numpy()
        ((_, self.data, off),) = text_slices(chunk, 1 << 62)
        self.starts, self.ends, at = word_bounds(self.data, off)
        n_words = np.diff(at)
        code = self.langs.dictionary_encode()
        self.names, self.lang_of = code.dictionary.to_pylist(), code.indices.to_numpy()
        seed = np.array([word_hashes(np.frombuffer(x.encode() or b" ", np.uint8), np.array([0]), np.array([len(x.encode() or b" ")]), False)[0] for x in self.names], U64)
        own = np.arange(len(self.starts)) - np.repeat(at[:-1], n_words)
        self.left = np.repeat(n_words, n_words) - own  # words from here to the end of the chunk
        self.counted = self.left > np.repeat(tail, n_words)
        self.chunk_of = np.repeat(np.arange(len(n_words)), n_words)
        self.words = mix64(word_hashes(self.data, self.starts, self.ends, lower=False) ^ seed[self.lang_of][self.chunk_of] * _K1)

    def weights(self, place: np.ndarray) -> np.ndarray:
        return np.where(self.counted[place], self.n[self.chunk_of[place]], 0)

    def hashes(self, size: int) -> np.ndarray:
        """Hashes of the phrases of that size from each word on; those that run over the end of a chunk mean nothing."""
        h = mix64(self.words + np.array([size], U64) * _K2)
        for j in range(1, size):
            h[:-j] = mix64(h[:-j] * _K1 + self.words[j:])
        return h

    def grouped(self, size: int, keep: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the phrases (of the places in keep), their counts here and the first place of each.  Those only in what
        belongs to the next chunk count 0: triples ask for them."""
        at = np.flatnonzero((self.left >= size) & keep)
        h = self.hashes(size)[at]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[heads], np.add.reduceat(self.weights(at), heads) if len(h) else np.zeros(0, np.int64), at[heads]


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _squeezed(h: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending hashes as differences, and other columns, by byte planes."""
    return zstandard.compress(_planes(np.diff(h, prepend=U64(0))) + b"".join(map(_planes, more)), 1)


def _opened(blob: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    first, *more = (_numbers(raw[i : i + 8 * n], n) for i in range(0, len(raw), 8 * n))
    return [np.cumsum(first, dtype=U64), *more]


def _columns(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield {c: batch.column(c)[i].values if pa.types.is_list(batch.schema.field(c).type) else batch.column(c)[i].as_py() for c in batch.schema.names}


_SENT = "dealt int, page long, n long, hashes binary"


def _send(bits: int):
    """Step 1: hashes and counts of words and pairs, dealt by the upper `bits` of the hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _columns(batch):
                page = _Page(row)
                parts = [page.grouped(size)[:2] for size in (1, 2)]
                h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                h = h >> U64(64 - BITS)
                order = np.argsort(h, kind="stable")
                h, n = h[order], n[order]
                edges = np.searchsorted(h, (np.arange((1 << bits) + 1, dtype=np.float64) * 2.0 ** (BITS - bits)).astype(U64))
                spans = [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in spans], pa.int32()), pa.array([row["page"]] * len(spans), pa.int64()), pa.array([b - a for _, a, b in spans], pa.int64()), pa.array([_squeezed(h[a:b], n[a:b]) for _, a, b in spans], pa.binary())],
                    names=["dealt", "page", "n", "hashes"],
                )

    return task


def _answer(least: int):
    """Step 2: of the hashes that each page sent those whose counts add up to `least`."""

    def task(table: pa.Table) -> pa.Table:
        sent = [_opened(b, n) for b, n in zip(table["hashes"].to_pylist(), table["n"].to_pylist(), strict=True)]
        h = np.concatenate([s[0] for s in sent])
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sums = np.add.reduceat(np.concatenate([s[1] for s in sent])[order], heads)
        frequent = ranked[heads][sums >= U64(least)]
        pages, sizes, blobs = [], [], []
        for page, (own, _) in zip(table["page"].to_pylist(), sent, strict=True):
            at = np.minimum(np.searchsorted(frequent, own), max(len(frequent) - 1, 0))
            own = own[frequent[at] == own] if len(frequent) else own[:0]
            own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
            if len(own):
                pages.append(page)
                sizes.append(len(own))
                blobs.append(_squeezed(own))
        return pa.table({"page": pa.array(pages, pa.int64()), "m": pa.array(sizes, pa.int64()), "frequent": pa.array(blobs, pa.binary())})

    return task


_GRAMS = "lang string, size int, phrase string, n long"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: frequent words and pairs, triples of frequent pairs, and all words of each language (size 0), with counts."""
    for batch in batches:
        for row in _columns(batch):
            page = _Page(row)
            answers = row["answers"].to_pylist() if row["answers"] is not None else []
            known = np.sort(np.concatenate([_opened(a["frequent"], a["m"])[0] for a in answers])) if answers else np.zeros(0, U64)

            def frequent(size: int, page: _Page = page, known: np.ndarray = known) -> np.ndarray:
                h = page.hashes(size) >> U64(64 - BITS)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                return (known[at] == h) & (page.left >= size) if len(known) else np.zeros(len(h), bool)

            pair = frequent(2)
            triple = pair & np.append(pair[1:], False) & (page.left >= 3)
            total = np.zeros(len(page.names), np.int64)
            np.add.at(total, page.lang_of[page.chunk_of[page.counted]], page.weights(np.flatnonzero(page.counted)))
            yield pa.RecordBatch.from_arrays([pa.array(page.names, pa.string()), pa.array([0] * len(total), pa.int32()), pa.array([""] * len(total), pa.string()), pa.array(total)], names=["lang", "size", "phrase", "n"])
            for size, keep in ((1, frequent(1)), (2, pair), (3, triple)):
                _, n, at = page.grouped(size, keep & page.counted)
                yield pa.RecordBatch.from_arrays(
                    [page.langs.take(pa.array(page.chunk_of[at])), pa.array([size] * len(at), pa.int32()), _strings(page.data, page.starts[at], page.ends[at + size - 1]), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"]
                )


def dictionary(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The prefix-free parse: distinct chunks of each language (null: und), how many words at their end belong to the next chunk, and
    how often they occur.  A null text has none."""
    parts = df.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(_parse, "lang string, chunk string, tail int")
    return parts.groupBy("lang", "chunk", "tail").agg(F.count("*").alias("n"))


def phrase_counts(df: DataFrame, least: int = 10, text: str = "text", lang: str = "lang", page_bytes: int = PAGE_BYTES, task_words: int = WORDS_A_TASK) -> DataFrame:
    """(lang, size, phrase, n): all words (size 0, phrase empty) of each language, and every word, pair and triple with at least `least`
    occurrences, each within a piece."""
    parsed = dictionary(df, text, lang)
    pages = written(parsed.mapInArrow(_pages(page_bytes), _PAGE), "phrase-pages")
    total = pages.agg(F.sum("words")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / task_words))))
    tags = pages.select("page", "lang", "chunk", "tail", "n")
    sent = tags.mapInArrow(_send(bits), _SENT)
    answers = sent.groupBy("dealt").applyInArrow(_answer(least), "page long, m long, frequent binary")
    answered = answers.groupBy("page").agg(F.collect_list(F.struct("m", "frequent")).alias("answers"))
    grams = tags.join(answered, "page", "left").mapInArrow(_grams, _GRAMS)
    summed = grams.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return written(summed.where((F.col("size") == 0) | (F.col("n") >= least)), "phrases")


def collocations(df: DataFrame, least: int = 10, top: int = 2000, share: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first `top` phrases of 2 and 3 words of each language by score.

    Texts are lower-cased (A-Z), split at . , ; : ! ? and line ends into pieces, and at spaces and tabs into words.  A phrase with a
    occurrences, at least `least`, scores floor(10^6 a^2 / (l r)) for the cut into two parts of l and r occurrences that scores least
    (of equal cuts the first).  A phrase inside a longer one is left out if the longer one has `share` percent of its
    occurrences.  Returns lang, rank, phrase, a, l, r, n (words of the language), score; ties by a, then by the phrase's bytes.  A null lang
    is und; null, empty and blank texts have no words; each repeated row counts; other columns don't matter; an empty table gives an
    empty table.  Counts are exact: hashes of 48 bits only choose what is counted (they can't miss a phrase), and inside one
    page of the dictionary phrases are told apart by 64-bit hashes.
    """
    grams = phrase_counts(df, least, text, lang)
    big = lambda c: F.col(c).cast("decimal(15,0)")
    words = F.split("phrase", " ")
    one = grams.where("size = 1")
    pairs = grams.where("size = 2").select("lang", "phrase", F.col("n").alias("a"), words[0].alias("w1"), words[1].alias("w2"))
    triples = grams.where("size = 3").select("lang", "phrase", F.col("n").alias("a"), words[0].alias("w1"), F.concat_ws(" ", words[1], words[2]).alias("p2"), F.concat_ws(" ", words[0], words[1]).alias("p1"), words[2].alias("w3"))

    def counted(table: DataFrame, part: str, of: DataFrame, name: str) -> DataFrame:
        return table.join(of.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])

    score = lambda l, r: F.expr(f"cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0))) as bigint)")  # noqa: E731,E741
    two = grams.where("size = 2")
    pairs = counted(counted(pairs, "w1", one, "l"), "w2", one, "r").withColumn("score", score("l", "r"))
    longer = triples.select("lang", F.col("p1").alias("phrase"), "a").unionByName(triples.select("lang", F.col("p2").alias("phrase"), "a")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    pairs = pairs.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * big("longer") < share * big("a")))
    triples = counted(counted(counted(counted(triples, "w1", one, "l1"), "p2", two, "r1"), "p1", two, "l2"), "w3", one, "r2")
    triples = triples.withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    every = pairs.select("lang", "phrase", "a", "l", "r", "score").unionByName(triples)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = every.withColumn("rank", rank).where(F.col("rank") <= top)
    n = grams.where("size = 0").select("lang", "n")
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
