"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams.

The model is a set of files in the shared folder: for words and for the n-grams of each length the sorted
64-bit hashes and a row of log scores per hash.  Workers map them into memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import fresh_path, held, text_slices, word_hashes, written
from .files import Output, mapped
from .tokens import piece_bounds

LONGEST = 5
#: About so many labelled documents of each language, picked by a hash of their id, fit the model: all of a
#: language that has fewer.  This bounds the model at any input size; nothing of the sample is cut.
TRAIN_DOCS = 1_500
#: Bytes of word scores that a worker keeps.
CACHE_BYTES = 8 << 20
#: The seed of Spark's xxhash64.
_SEED = 42


@dataclass
class Model:
    """File names and a few numbers; table 0 has words, table n the n-grams of length n."""

    langs: list[str]
    tables: list[tuple[str, str]]
    prior: np.ndarray
    key: str


class Scorer:
    """Log scores of words from the mapped tables, and their sums over texts; scores of pieces met before are kept, within CACHE_BYTES."""

    def __init__(self, model: Model):
        import regex
        import xxhash

        self.letters, self.hash = regex.compile(r"\p{L}+"), xxhash.xxh64_intdigest
        self.model, self.width = model, len(model.langs) + 1
        self.tables = [(mapped(h, "<u8"), mapped(s, "<f4").reshape(-1, len(model.langs))) for h, s in model.tables]
        self.most = max(1 << 12, CACHE_BYTES // (8 + 4 * self.width))
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, self.width), np.float32)

    def _found(self, table: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is in a table, and its place."""
        keys = self.tables[table][0]
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, at

    def words(self, words: list[str]) -> np.ndarray:
        """A row of log scores per word: its own, or the mean of those of its longest n-grams that are known."""
        out = np.full((len(words), self.width - 1), -np.log(self.width - 1), np.float32)
        hashes = np.array([self.hash(w.encode(), seed=_SEED) for w in words], np.uint64)
        hit, at = self._found(0, hashes)
        out[hit] = self.tables[0][1][at[hit]]
        left = np.flatnonzero(~hit)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            marked = [f"_{words[i]}_" for i in left]
            count = np.array([max(0, len(m) - n + 1) for m in marked])
            grams = np.array([self.hash(m[i : i + n].encode(), seed=_SEED) for m in marked for i in range(len(m) - n + 1)], np.uint64)
            hit, at = self._found(n, grams)
            owner = np.repeat(np.arange(len(left)), count)[hit]
            known = np.bincount(owner, minlength=len(left))
            rows = self.tables[n][1][at[hit]]
            some = known > 0
            for c in range(self.width - 1):
                out[left[some], c] = (np.bincount(owner, weights=rows[:, c], minlength=len(left)) / np.maximum(known, 1))[some]
            left = left[~some]
        return out

    def _pieces(self, raw: list[bytes]) -> np.ndarray:
        """A row per piece: sums over its words, and their number."""
        out = np.zeros((len(raw), self.width), np.float32)
        words, owner = [], []
        for i, piece in enumerate(raw):
            for w in self.letters.findall(piece.decode().lower()):
                words.append(w)
                owner.append(i)
        if words:
            np.add.at(out, np.array(owner), np.concatenate([self.words(words), np.ones((len(words), 1), np.float32)], axis=1))
        return out

    def sums(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row per text: a sum for each language and the number of words."""
        starts, ends, at = piece_bounds(data, off)
        hashes, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != hashes
        if new.any():
            raw = data.tobytes()
            learnt = self._pieces([raw[starts[i] : ends[i]] for i in first[new].tolist()])
            if len(self.keys) + len(learnt) > self.most:  # this slice's pieces only
                old = np.empty((len(hashes), self.width), np.float32)
                old[~new], old[new] = self.rows[place[~new]], learnt
                self.keys, self.rows = hashes, old
            else:
                self.keys, self.rows = np.insert(self.keys, place[new], hashes[new]), np.insert(self.rows, place[new], learnt, axis=0)
            place = np.searchsorted(self.keys, hashes)
        rows = self.rows[place]
        n = len(off) - 1
        owner = np.repeat(np.arange(n), np.diff(at))
        return np.stack([np.bincount(owner, weights=rows[:, c][inverse], minlength=n) for c in range(self.width)], axis=1)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learn from docs(doc_id, text, lang) with a lang; None if none has one (or there is no such column).

    Of each language about train_docs rows are used, those whose id hashes lowest, or all if it has
    fewer, so a rare language is learnt too.  Words and n-grams of the sample are counted in Spark and
    all kept; their scores, which are bounded by the sample, are written by the driver.
    """
    if "lang" not in docs.columns:
        return None
    spark = docs.sparkSession
    named = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    per = written(named.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # a row per language
    chosen = per.select(F.col("lang").alias("of"), (F.lit(float(1 << 30)) * train_docs / F.col("n")).alias("most"))
    sample = named.join(chosen, F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("most"))
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    counted = written(sample.select("lang", F.explode(letters).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n")), "language-words")
    langs = [r.lang for r in counted.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    docs_of = {r.lang: r.n for r in per.where(F.col("lang").isin(langs)).collect()}

    marked = F.concat(F.lit("_"), "w", F.lit("_"))

    def grams(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - (n - 1)))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("kind"), F.substring(marked, i, F.lit(n)).alias("g")))

    units = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("w").alias("g"))), *(grams(n) for n in range(1, LONGEST + 1)))
    rows = counted.select("lang", "n", F.explode(units).alias("u")).where("(u.kind = 0 or length(u.g) = u.kind) and not (u.kind = 1 and u.g = '_')")
    rows = rows.groupBy("u.kind", F.xxhash64("u.g").alias("h"), "lang").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample

    kind, n = rows.column("kind").to_numpy(), rows.column("n").to_numpy().astype(float)
    hashes = rows.column("h").to_numpy().view(np.uint64)
    lang = np.searchsorted(np.array(langs), np.array(rows.column("lang").to_pylist()))
    folder, tables = fresh_path(spark, "languages"), []
    for k in range(LONGEST + 1):
        mine = kind == k
        keys, at = np.unique(hashes[mine], return_inverse=True)
        v = np.zeros((len(keys), len(langs)))
        np.add.at(v, (at, lang[mine]), n[mine])
        logs = np.log((v + 0.5) / (1 + v.sum(axis=0) + 0.5 * (len(v) + 1)))
        names = f"{folder}/{k}.hashes", f"{folder}/{k}.scores"
        for name, a in zip(names, (keys.astype("<u8"), logs.astype("<f4")), strict=True):
            out = Output(name)
            out.write(a.tobytes())
            out.close()
        tables.append(names)
    prior = np.array([docs_of[x] for x in langs], float)
    return Model(langs, tables, np.log(prior / prior.sum()), uuid.uuid4().hex)


def _with_language(docs: DataFrame, model: Model | None, pred: str, score: str) -> DataFrame:
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held("language", model.key, lambda: Scorer(model)) if model else None
        for batch in batches:
            preds, certain = [], []
            for _, data, off in text_slices(batch.column(text_at)):
                if scorer is None or not len(data):
                    preds += ["und"] * (len(off) - 1)
                    certain += [0.0] * (len(off) - 1)
                    continue
                sums = scorer.sums(data, off)
                words = sums[:, -1]
                log = (sums[:, :-1] + model.prior) / np.maximum(words, 1)[:, None]
                best = log.argmax(axis=1)
                odds = np.exp(log - log.max(axis=1, keepdims=True))
                preds += [model.langs[b] if w else "und" for b, w in zip(best, words, strict=True)]
                certain += np.where(words > 0, 1 / odds.sum(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(certain, pa.float64())], [*names, pred, score])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(text, other columns stay, but for any lang_pred and score) with lang_pred and score.

    lang_pred has the largest posterior over all words; score is the posterior of an average word (0 to 1,
    the languages' geometric mean likelihoods), so it doesn't saturate with length and is low for a text of
    two languages.  A null text or one without a letter (\\p{L}) is und with score 0, as is everything
    without a model.  Words count by their letters, lower-cased.  Repeated rows stay and score alike.  One
    pass over the rows, whole texts, no shuffle.
    """
    return _with_language(docs.drop("lang_pred", "score"), model, "lang_pred", "score")


def third(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3


def accepted(docs: DataFrame, train: DataFrame | None = None, min_score: float | None = None) -> DataFrame:
    """The documents with an identified language, with all their columns.

    und goes, and a score below min_score, by default 1.2 times that of a draw between all languages.
    Where nothing is labelled no language can be told, so every text with a letter stays.
    """
    model = fit(docs if train is None else train)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = 1.2 / len(model.langs) if min_score is None else min_score
    tag = "_" + "_".join(docs.columns)
    rows = _with_language(docs, model, f"pred{tag}", f"score{tag}")
    return rows.where((F.col(f"pred{tag}") != "und") & ((F.col(f"score{tag}") >= least) | (F.lit(len(model.langs)) == 1))).select(*docs.columns)
