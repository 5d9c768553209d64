"""Trades of a rule with every kind of exit, and re-entry after each (LBL-12, SCN-11)."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


REASONS = ("underlying_stop", "stop_loss", "target", "trail_stop", "signal", "time_stop", "eod_force")
SPAN, BLOCK = 16, 8_192  # rows from an entry, it included, and entries looked at at once
NAMES = ("entry_minute", "exit_minute", "entry_price", "exit_price", "net", "exit_reason", "mfe", "mae")


@dataclass(frozen=True)
class Exits:
    """Shares, not percents; minutes since entry for the time stop, of the day for the close.  None: no such exit."""

    stop: float
    target: float
    time_stop: int
    day_end: int
    trail_arm: float | None = None
    trail_back: float | None = None
    underlying_stop: float | None = None
    sign: int = 1
    cost: float = 0.0002


def rule_trades(df: DataFrame, keys: Sequence[str], minute: str, price: str, signal: Column, exits: Exits, underlying: str | None = None, leave: Column | None = None) -> DataFrame:
    """LBL-12: walk each day (keys) by minute; enter at a signal when not in a trade, leave at the first row after it at which an exit holds, in this order
    at one row: underlying_stop, stop_loss, target, trail_stop, signal (the column `leave`), time_stop, eod_force; the day's last row
    ends a trade too.  The row of an exit may be the next entry.

    Gains are a share of the entry's price times the sign; mfe and mae begin at 0.  Rows without a price can only end a trade by
    time or the day's end, and a trade that ends without a price above 0 is none: the walk goes on after its entry.  Returns
    keys, entry_minute, exit_minute, entry_price, exit_price, net, exit_reason, mfe, mae.  A day is one task's.  The first rows after
    each entry are looked at for all entries at once; a trade still open then is followed in arrays that double, so a trade's work is
    in proportion to the rows it is held (and those of trades that are none are read again by the next).
    """
    x = exits
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers may not have this package
    rows = df.select(
        *keys, F.col(minute).cast("long").alias("_m"), F.col(price).cast("double").alias("_p"), (F.col(underlying).cast("double") if underlying else F.lit(None).cast("double")).alias("_u"),
        F.coalesce(signal, F.lit(False)).alias("_s"), F.coalesce(leave, F.lit(False)).alias("_x") if leave is not None else F.lit(False).alias("_x"),
    )

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_m")
        m, p, u = (table[c].to_numpy().astype(float) for c in ("_m", "_p", "_u"))
        enter = np.flatnonzero(np.array(table["_s"].to_pylist(), bool) & (p > 0))
        go = np.array(table["_x"].to_pylist(), bool)
        final = len(m) - 1

        def look(i: np.ndarray, lo: int, hi: int, mfe: np.ndarray, mae: np.ndarray) -> tuple[np.ndarray, ...]:
            """Of the rows lo to hi - 1 places after each entry of i the first exit, or the last row: row, reason (7: none), gain, mfe, mae.  Those given hold before lo."""
            j = np.minimum(i[:, None] + np.arange(lo, hi), final)
            p0, u0 = p[i][:, None], np.where(u[i] > 0, u[i], np.nan)[:, None]
            gain = x.sign * (p[j] - p0) / p0
            some = ~np.isnan(gain)
            mfe = np.maximum.accumulate(np.maximum(np.where(some, gain, 0.0), mfe[:, None]), axis=1)
            mae = np.minimum.accumulate(np.minimum(np.where(some, gain, 0.0), mae[:, None]), axis=1)
            why = np.full(j.shape, 7)
            tests = [(6, (m[j] >= x.day_end) | (j == final)), (5, m[j] - m[i][:, None] >= x.time_stop), (4, some & go[j])]
            if x.trail_arm is not None and x.trail_back is not None:
                tests.append((3, some & (mfe >= x.trail_arm) & (gain <= mfe - x.trail_back)))
            tests += [(2, some & (gain >= x.target)), (1, some & (gain <= -x.stop))]
            if x.underlying_stop is not None:
                tests.append((0, some & (x.sign * (u[j] - u0) / u0 < -x.underlying_stop)))
            for code, holds in tests:
                why[holds] = code
            hit = why < 7
            at = np.arange(len(i)), np.where(hit.any(axis=1), hit.argmax(axis=1), hi - lo - 1)
            return j[at], why[at], gain[at], mfe[at], mae[at]

        blocks = [enter[b : b + BLOCK] for b in range(0, max(len(enter), 1), BLOCK)]
        end, why, gain, mfe, mae = (np.concatenate(c) for c in zip(*(look(i, 1, SPAN, np.zeros(len(i)), np.zeros(len(i))) for i in blocks), strict=True))
        why[enter == final], gain[enter == final] = 6, 0.0  # no row after it
        place = np.searchsorted(enter, end)
        k, taken = 0, []
        while k < len(enter):
            lo, one = SPAN, slice(k, k + 1)
            while why[k] == 7:
                end[one], why[one], gain[one], mfe[one], mae[one] = look(enter[one], lo, 2 * lo, mfe[one], mae[one])
                place[k], lo = np.searchsorted(enter, end[k]), 2 * lo
            if p[end[k]] > 0:
                taken.append(k)
                k = max(k + 1, int(place[k]))
            else:
                k += 1
        i, j = enter[taken], end[taken]
        columns = [m[i], m[j], p[i], p[j], gain[taken] - x.cost, np.array(REASONS, object)[why[taken]], mfe[taken], mae[taken]]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64()]
        day = table.select(list(keys)).take(pa.array(i))
        return pa.table([*day.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*keys, *NAMES])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", entry_minute long, exit_minute long, entry_price double, exit_price double, net double, exit_reason string, mfe double, mae double"
    return rows.groupBy(*keys).applyInArrow(walk, schema)
