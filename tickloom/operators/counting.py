"""Order statistics of a sequence's past, by merge counting in blocks of bounded size.

How many earlier values are below a value is counted while sorted halves are merged, n log n in all, in arrays.  A history
of a fixed number of rows needs a block of that many rows and the block before it, so a task holds two blocks however long
the sequence is, and each row goes to two tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def earlier(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many before it are smaller, and how many equal.  NaN equals NaN and is above all."""
    n = len(values)
    _, ranks = np.unique(values, return_inverse=True)
    less, upto = np.zeros(n, np.int64), np.zeros(n, np.int64)
    place = np.arange(n)
    kinds = int(ranks.max(initial=0)) + 1
    size = 1
    while size < n:
        pair, right = place // (2 * size), place // size % 2
        for out, first in ((less, right), (upto, 1 - right)):  # of equal values the right ones first, or the left ones
            key = (pair * kinds + ranks) * 2 + (1 - first)
            order = np.argsort(key, kind="stable")
            lefts = np.cumsum(1 - right[order])
            starts = np.searchsorted(pair[order], pair[order])
            before = np.where(starts > 0, lefts[starts - 1], 0)
            counted = np.where(right[order] == 1, lefts - before, 0)
            out[order] += counted
        size *= 2
    return less, upto - less


def trailing(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many of the `window` values before it are at most as large, and how many there are.

    Of the first i values those at most v_i, less those among the first i - window: the second is asked by an extra query value
    that stands just after those."""
    n = len(values)
    less, same = earlier(values)
    seen = np.minimum(np.arange(n), window)
    if n <= window:
        return less + same, seen
    at = np.arange(window, n)  # rows whose window has lost some
    _, ranks = np.unique(values, return_inverse=True)
    # values and queries in one sequence: after value j comes the query of row j + window + 1
    place = np.concatenate([np.arange(n) * 2.0, (at - window) * 2.0 - 1])
    what = np.concatenate([ranks * 2.0, ranks[at] * 2.0 + 1])  # a query is above equal values and counts only values
    order = np.argsort(place, kind="stable")
    gone = _below(what[order], (order < n))
    out = np.zeros(len(order), np.int64)
    out[order] = gone
    total = less + same
    total[at] -= out[n:]
    return total, seen


def _below(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each place how many earlier values that count are smaller."""
    n = len(values)
    _, ranks = np.unique(values, return_inverse=True)
    out, place, kinds, size = np.zeros(n, np.int64), np.arange(n), int(ranks.max(initial=0)) + 1, 1
    while size < n:
        pair, right = place // (2 * size), place // size % 2
        order = np.argsort((pair * kinds + ranks) * 2 + (1 - right), kind="stable")
        lefts = np.cumsum(((1 - right) * counts)[order])
        starts = np.searchsorted(pair[order], pair[order])
        out[order] += np.where(right[order] == 1, lefts - np.where(starts > 0, lefts[starts - 1], 0), 0)
        size *= 2
    return out


def _plain(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """A column as floats if it holds them, else as integers that order alike; no nulls."""
    column = table[names].combine_chunks()
    if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.unique(np.array(column.to_pylist(), dtype=object), return_inverse=True)[1]


def earlier_counts(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with _less, _same and _n: of the rows of the session before this one those with a smaller and an equal x, and those with
    any.  A session is in one task; its time grows with n log n.  Rows with a null x get nulls."""
    given = [f"_o{i}" for i in range(len(order))]
    rows = df.withColumns({g: F.col(o) for g, o in zip(given, order, strict=True)})
    schema = to_arrow_schema(df.schema)
    names = df.columns

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([(g, "ascending") for g in given]).select(names)
        there = ~np.array(table[x].combine_chunks().is_null().to_numpy(zero_copy_only=False))
        less, same, n = (np.zeros(len(table), np.int64) for _ in range(3))
        less[there], same[there] = earlier(_plain(table.filter(pa.array(there)), x))
        n[there] = np.arange(there.sum())
        table = table.cast(schema)
        for name, column in (("_less", less), ("_same", same), ("_n", n)):
            table = table.append_column(name, pa.array(column, mask=~there))
        return table

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers may not have this package
    out = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in ("_less", "_same", "_n"))])
    return rows.groupBy(*keys).applyInArrow(task, out)


def positions(df: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], out: str) -> DataFrame:
    """The place of each row in its whole sequence, from 0: rows of the days before, added up over a row per day, and the place in the day."""
    days = df.groupBy(*keys, day).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = days.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, day])), before.alias("_before"))
    numbered = df.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, day).orderBy(*order)))
    same = [numbered[c].eqNullSafe(offsets[f"_k{i}"]) for i, c in enumerate([*keys, day])]
    return numbered.join(offsets, same).withColumn(out, F.col("_before") + F.col("_in") - 1).select(*df.columns, out)


def history_percentile_rows(df: DataFrame, x: str, keys: Sequence[str], day: str, order: Sequence[str], out: str, rows: int = 30_000, least: int = 1) -> DataFrame:
    """WIN-12: 100 * share of the last `rows` earlier values of the sequence (over all its days) that are at most x; null with fewer than
    `least` of them.  Rows with a null x get null and are no history.  keys: a sequence, of any length; day: its partition in time."""
    valued = positions(df.where(F.col(x).isNotNull()), keys, day, order, "_at")
    block = F.floor(F.col("_at") / rows)
    dealt = valued.withColumn("_block", F.explode(F.array(block, block + 1)))
    schema, names = to_arrow_schema(df.schema), df.columns
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        at, mine = table["_at"].to_numpy(), table["_block"][0].as_py()
        upto, seen = trailing(_plain(table, x), rows)
        own = at // rows == mine
        share = np.full(len(at), np.nan)
        enough = (seen >= least) & (seen > 0)
        share[enough] = 100.0 * upto[enough] / seen[enough]
        kept = table.select(names).cast(schema).append_column(out, pa.array(share, mask=~enough))
        return kept.filter(pa.array(own))

    found = dealt.groupBy(*keys, "_block").applyInArrow(task, StructType([*df.schema.fields, StructField(out, DoubleType())]))
    return found.unionByName(df.where(F.col(x).isNull()).withColumn(out, F.lit(None).cast("double")))
