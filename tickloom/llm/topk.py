"""Exact top-k search by integer inner product with a pivot-distance index.

Vectors are rounded down to multiples of 1 / `scale` and searched as integers.  A further component, sqrt(M - |v|^2) with
M the largest |v|^2 (0 for a query), turns the greatest inner products into the least distances:
d(q, v)^2 = |q|^2 + M - 2 q.v.  The index keys every distinct vector by its nearest pivot and its distance from it,
sorted, in annuli of about `ANNULUS` vectors.  A query orders the annuli by the lower bound that the triangle inequality
gives, expands the first, then some more, then all whose bound its k-th best distance does not exclude.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import written

#: Vectors that the pivots are fitted on, pivots and annuli at most, and vectors of an annulus at least.
SAMPLE, PIVOTS, ANNULI, ANNULUS = 8192, 256, 16384, 2048
#: Queries that a row asks an annulus for, at most.
QUERIES = 2048
#: Annuli that a query has expanded after each round but the last, which takes the rest.
ROUNDS = (1, 8)
_KINDS = (np.int8, np.int16, np.int32, np.int64)
_BESTS = "q binary, score long, ids array<bigint>"


def _packed(x: np.ndarray) -> bytes:
    """Integers in the narrowest kind that holds them, so that equal vectors are equal bytes."""
    for code, kind in enumerate(_KINDS):
        info = np.iinfo(kind)
        if not len(x) or info.min <= x.min() and x.max() <= info.max:
            return bytes([code]) + x.astype(kind).tobytes()
    raise AssertionError


def _matrix(packed: list[bytes], dims: int) -> np.ndarray:
    """Vectors as rows of 64-bit integers; missing components are 0."""
    if packed and len({(p[0], len(p)) for p in packed}) == 1 and len(packed[0]) == 1 + dims * np.dtype(_KINDS[packed[0][0]]).itemsize:
        return np.frombuffer(b"".join(p[1:] for p in packed), _KINDS[packed[0][0]]).reshape(len(packed), dims).astype(np.int64)
    out = np.zeros((len(packed), dims), np.int64)
    for row, p in zip(out, packed, strict=True):
        x = np.frombuffer(p, _KINDS[p[0]], offset=1)
        row[: len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in floats where those hold them exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    raise OverflowError("an inner product doesn't fit a long")


def _integers(scale: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            flat, off = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())])
            rounded = np.floor(flat * scale)
            if (np.abs(rounded) >= 2.0**62).any():
                raise OverflowError("a component doesn't fit a long")
            whole = rounded.astype(np.int64)
            rows = [whole[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
            own = [int((r.astype(object) ** 2).sum()) if np.abs(r).max(initial=0) > 1 << 20 else int((r * r).sum()) for r in rows]
            if max(own, default=0) >= 1 << 63:
                raise OverflowError("an inner product doesn't fit a long")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([_packed(r) for r in rows], pa.binary()), pa.array(own, pa.int64()), pa.array([len(r) for r in rows], pa.int32())], names=["id", "asks", "v", "own", "dims"]
            )

    return task


class Pivots:
    """Pivots with their further component, and distances from them."""

    def __init__(self, sample: np.ndarray, most: float, count: int, rounds: int = 6):
        self.most = most
        x = self.lifted(sample)
        rng = np.random.default_rng(7)
        at = x[rng.choice(len(x), min(count, len(x)), replace=False)]
        for _ in range(rounds):
            near = self._squares(x, at).argmin(axis=1)
            sums, n = np.zeros_like(at), np.bincount(near, minlength=len(at))
            np.add.at(sums, near, x)
            at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
        self.at = at

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(float)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        return np.concatenate([x, more[:, None]], axis=1)

    @staticmethod
    def _squares(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(axis=1)[:, None] + (at * at).sum(axis=1) - 2 * x @ at.T, 0)

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return np.sqrt(self._squares(self.lifted(x, query), self.at))


def _keyed(pivots: Pivots, dims: int, query: bool):
    """Add the nearest pivot and the distance from it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d = pivots.distances(_matrix(batch.column(0).to_pylist(), dims), query)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], names=[*batch.schema.names, "pivot", "distance"])

    return task


_ANNULUS = "block long, pivot int, low double, high double, n long, ids array<array<bigint>>, vectors array<binary>"


def _annuli(size: int):
    """Cut rows sorted by pivot and distance into annuli of one pivot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, pivot = 0, [], None
        part = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            v, ids, d = ([x for h in held for x in h[j]] for j in range(3))
            values = (part + seq, pivot, d[0], d[-1], len(v), ids, v)
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["block", "pivot", "low", "high", "n", "ids", "vectors"])

        for batch in batches:
            v, ids, p, d = (batch.column(n).to_pylist() for n in ("v", "ids", "pivot", "distance"))
            i = 0
            while i < len(v):
                if held and (p[i] != pivot or sum(len(h[0]) for h in held) >= size):
                    yield block()
                    seq, held = seq + 1, []
                pivot = p[i]
                room = size - sum(len(h[0]) for h in held)
                j = i
                while j < len(v) and p[j] == pivot and j - i < room:
                    j += 1
                held.append((v[i:j], ids[i:j], d[i:j]))
                i = j
        if held:
            yield block()

    return task


_REQUEST = "block long, queries array<binary>, bars array<bigint>"


def _requests(pivots: Pivots, dims: int, known: dict[str, np.ndarray], begin: int, end: int | None):
    """For each annulus the queries that expand it: those in whose order it is one of begin to end and whose bar, the
    score of their k-th best so far, its lower bound doesn't exclude."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack = 1e-6 * (pivots.most**0.5 + 1)
        for batch in (b.slice(at, QUERIES) for b in batches for at in range(0, len(b), QUERIES)):
            packed, bars = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            asked: dict[int, list[int]] = {}
            for i in range(0, len(packed), 64):
                x = _matrix(packed[i : i + 64], dims)
                d = pivots.distances(x, query=True)
                own = d[:, known["pivot"]]
                bound = np.maximum(np.maximum(own - known["high"], known["low"] - own), (own - d.min(axis=1)[:, None]) / 2)
                bound = np.maximum(bound - slack, 0)
                wanted = np.ones(bound.shape, bool)
                if begin or end is not None:
                    order = np.lexsort((own, bound), axis=1)
                    np.put_along_axis(wanted, order, (np.arange(bound.shape[1]) >= begin) & (np.arange(bound.shape[1]) < (bound.shape[1] if end is None else end))[None, :], axis=1)
                reach = (x.astype(float) ** 2).sum(axis=1) + pivots.most
                limit = np.array([np.inf if b is None else r - 2.0 * b + slack for b, r in zip(bars[i : i + 64], reach.tolist(), strict=True)])
                for q, b in zip(*np.nonzero(wanted & (bound * bound <= limit[:, None])), strict=True):
                    asked.setdefault(int(b), []).append(i + int(q))
            names = ["block", "queries", "bars"]
            for b, rows in asked.items():
                yield pa.RecordBatch.from_arrays([pa.array([int(known["block"][b])], pa.int64()), pa.array([[packed[r] for r in rows]], pa.list_(pa.binary())), pa.array([[bars[r] for r in rows]], pa.list_(pa.int64()))], names=names)

    return task


def _scored(dims: int, keep: int):
    """The best `keep` vectors of an annulus for each of its queries, ties to the smaller first id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                least = np.array([x[0] for x in row["ids"]], np.int64)
                s = _products(_matrix(row["queries"], dims), _matrix(row["vectors"], dims))
                floor = np.iinfo(np.int64).min
                bar = np.array([floor if b is None else b for b in row["bars"]], np.int64)
                if s.shape[1] > keep:
                    bar = np.maximum(bar, np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep])
                q, v = np.nonzero(s >= bar[:, None])
                order = np.lexsort((least[v], -s[q, v], q))
                q, v = q[order], v[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, v = q[rank < keep], v[rank < keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["queries"][i] for i in q.tolist()], pa.binary()), pa.array(s[q, v], pa.int64()), pa.array([row["ids"][i] for i in v.tolist()], pa.list_(pa.int64()))], names=["q", "score", "ids"]
                )

    return task


def nearest(df: DataFrame, asks: Column, k: int = 20, ident: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """The k vectors of greatest integer inner product for each row where `asks` holds, among all other rows.

    Returns query_id, rank (from 1), vec_id and score; equal scores go by the smaller id; a query with fewer other rows has
    them all.  Rows with a null id, a null vector or a null, NaN or infinite component take no part.  A
    component is floor(scale * x); components beyond the end of a shorter vector are 0.  Each row is a candidate and, where
    asked for, a query of its own, repeated ids too; a query leaves out one row of its own id and vector, itself.  Products that a long
    can't hold raise OverflowError.  An empty table gives an empty table; other columns don't matter.

    Exact: equal vectors are indexed once with their k + 1 least ids, as further copies can be in no answer.  Pivots
    are fitted on SAMPLE vectors; every vector is indexed.  The driver holds the pivots and one row for each annulus (at most
    ANNULI and one for each pivot and task).
    """
    spark = df.sparkSession
    fine = F.col(ident).isNotNull() & F.forall(vector, lambda x: F.abs(x.cast("double")) < float("inf"))
    rows = df.where(fine).select(F.col(ident).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("x"))
    rows = written(rows.mapInArrow(_integers(scale), "id long, asks boolean, v binary, own long, dims int"), "vectors")
    copies = rows.select("v", "id", "own", "dims", F.row_number().over(Window.partitionBy("v").orderBy("id")).alias("place")).where(F.col("place") <= k + 1)
    distinct = written(copies.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("own").alias("own"), F.max("dims").alias("dims")), "distinct-vectors")
    total = distinct.agg(F.count("*").alias("n"), F.max("own").alias("most"), F.max("dims").alias("dims")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not total.n:
        return empty
    few = F.pmod(F.xxhash64("v"), F.lit(total.n)) < 2 * SAMPLE  # else each task sends SAMPLE vectors to the driver
    sample = [bytes(r.v) for r in distinct.where(few | F.lit(total.n <= 2 * SAMPLE)).orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()]
    pivots = Pivots(_matrix(sample, total.dims), float(total.most), min(PIVOTS, 1 + total.n // ANNULUS))
    size = max(ANNULUS, -(-total.n // ANNULI))

    keyed = distinct.select("v", "ids").mapInArrow(_keyed(pivots, total.dims, False), "v binary, ids array<bigint>, pivot int, distance double")
    parts = int(min(max(1, total.n // size), 4096))
    index = written(keyed.repartitionByRange(parts, "pivot", "distance", "v").sortWithinPartitions("pivot", "distance").mapInArrow(_annuli(size), _ANNULUS), "annuli")
    plan = index.select("block", "pivot", "low", "high").orderBy("block").toPandas()
    known = {c: plan[c].to_numpy() for c in plan.columns}

    queries = rows.where("asks").select("v").distinct().mapInArrow(_keyed(pivots, total.dims, True), "v binary, pivot int, distance double")
    queries = written(queries.repartitionByRange("pivot", "distance", "v").sortWithinPartitions("pivot", "distance").select("v"), "queries")
    best, begin = None, 0
    for end in (*(e for e in ROUNDS if e < len(plan)), None):
        barred = queries.withColumn("bar", F.lit(None).cast("long"))
        if best is not None:
            bars = best.groupBy(F.col("q").alias("v")).agg(F.when(F.count("*") > k, F.min("score")).alias("bar"))
            barred = queries.join(bars.hint("merge"), "v", "left").select("v", "bar")
        asked = barred.mapInArrow(_requests(pivots, total.dims, known, begin, end), _REQUEST)
        # A query is asked of many annuli, which Spark can't know: by its estimate it would broadcast all of them.
        hits = asked.join(index.select("block", "ids", "vectors").hint("merge"), "block").select("queries", "bars", "ids", "vectors").mapInArrow(_scored(total.dims, k + 1), _BESTS)
        hits = hits.select("q", "score", F.explode("ids").alias("id"))
        hits = hits if best is None else hits.unionByName(best)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        best, begin = written(hits.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "best"), end or 0
    listed = best.groupBy(F.col("q").alias("v")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    own = F.array_position("best", F.struct((-F.col("own")).alias("s"), "id"))
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("at")), 1, k)
    found = rows.where("asks").join(listed.hint("merge"), "v").withColumn("at", own).select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "hit"))
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
