"""Helpers that the operators of this subpackage share: written tables and vectorised text."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Hashable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch at most (a longer text makes a batch of its own).
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20

_own_root: dict[str, str] = {}


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python tasks hold in memory, and send this package to the executors.

    Lowers the two batch settings of the session where they are higher; nothing else of it changes.
    """
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="spark-")) / "tickloom_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one if unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own_root.setdefault(app, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return root.rstrip("/")


_held: dict[str, tuple[Hashable, object]] = {}


def held(kind: str, key: Hashable, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one object at a time, so an operator's next task finds its
    own and another operator's first task lets it go."""
    if kind not in _held or _held[kind][0] != key:
        _held.clear()
        _held[kind] = key, make()
    return _held[kind][1]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/tickloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- text as bytes

U64 = np.uint64
#: Odd multiplier, 5 modulo 8, of the polynomial word hash modulo 2**64, and its inverse.
_P = 0x9E3779B97F4A7C15 & ~7 | 5
_P_INV = pow(_P, -1, 1 << 64)
_K1, _K2, _K3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes that one table of powers covers; only a longer word needs a longer table, which isn't kept.
CHUNK = 1 << 19
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = (x ^ (x >> U64(30))) * _K1
    x = (x ^ (x >> U64(27))) * _K2
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if n <= CHUNK + 1 and _powers:
        return _powers
    tables = []
    for base in (_P, _P_INV):
        t = np.full(max(n, CHUNK + 1), base, dtype=U64)
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    if n <= CHUNK + 1:
        _powers[:] = tables
    return tables


def text_slices(column: pa.Array, max_bytes: int = 1 << 19):
    """Yield (first row, data bytes, offsets) of a string array in pieces of about max_bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + max_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+, and the index of the first word of each text (n + 1 long)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    inside = _IS_WORD[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~inside[:-1]
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, ~inside[1:]
    full = off[:-1][off[1:] > off[:-1]]
    first[full] = True
    last[off[1:][off[1:] > off[:-1]] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of ascending byte ranges that don't overlap; with lower, A-Z count as a-z."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, side="right")))
        piece = data[lo : ends[j - 1]]
        up, down = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, U64)
        np.cumsum(((_LOWER[piece] if lower else piece).astype(U64) + U64(1)) * up[: len(piece)], out=sums[1:])
        h = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        out[i:j] = mix64(h + (ends[i:j] - starts[i:j]).astype(U64) * _K3)
        i = j
    return out


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle."""
    starts, ends, at = word_bounds(data, off)
    words = word_hashes(data, starts, ends)
    n = len(words) - k + 1
    if n > 0:
        rolled = words[:n]
        for j in range(1, k):
            rolled = mix64(rolled * _K3 + words[j : n + j])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            h = words[a : a + 1]
            for j in range(a + 1, b):
                h = mix64(h * _K3 + words[j : j + 1])
            out.append(mix64(h + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out
