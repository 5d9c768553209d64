"""Stateful stream jobs in event time: any split of a table into files and micro-batches gives the same rows.

Rows wait in state until the watermark has passed them and are then handled in order of (time, id), whatever order they came in.
Event-time timers do that, and close a session when the watermark passes its end, which frees its state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: Microseconds of an hour, rows that are packed at a time, and rows of a frame of results.
HOUR, BUFFER, SHOWN = 3_600_000_000, 1 << 18, 1 << 14
ROW = np.dtype([("at", "i8"), ("event_id", "i8"), ("session", "i8"), ("minute", "i4"), ("price", "f8"), ("volume", "f8")])


class InOrder(StatefulProcessor):
    """What jobs in event time share.  A key's rows are (at: microseconds, event_id, session: days since 1970, minute, price, volume);
    a session ends with its day.  Keys that are null only carry the watermark.

    Waiting rows are packed by the hour, in parts of at most BUFFER rows, and read hour by hour when the watermark passes
    them, so a task holds one hour of a key, whatever waits."""

    #: State of an open session after its number; what a row adds to the result.
    state, columns = "", ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour long, part long", "rows binary")
        self.parts = handle.getValueState("parts", "n long")
        self.open = handle.getValueState("open", f"session long, {self.state}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, n, first = [], 0, None
        for frame in rows:
            frame = frame[frame["event_id"].notna() & frame["price"].notna()] if key[0] is not None else frame[:0]
            if len(frame):
                new = np.empty(len(frame), ROW)
                for c in ROW.names:
                    new[c] = frame[c].astype(ROW[c])
                least = int(new["at"].min())
                first = least if first is None else min(first, least)
                held.append(new)
                n += len(new)
                if n >= BUFFER:
                    self.keep(held)
                    held, n = [], 0
        if held:
            self.keep(held)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def keep(self, held: list[np.ndarray]) -> None:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows["at"], kind="stable")]
        hours = rows["at"] // HOUR
        starts = np.flatnonzero(np.diff(hours, prepend=hours[0] - 1))
        part = self.parts.get()[0] if self.parts.exists() else 0
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            self.waiting.updateValue((int(hours[a]), part), (rows[a:b].tobytes(),))
        self.parts.update((part + 1,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = tuple(self.open.get()) if self.open.exists() else None
        places = sorted((int(h), int(p)) for h, p in self.waiting.keys()) if self.waiting.exists() else []
        left, out = None, []
        for hour, parts in groupby(places, key=lambda p: p[0]):
            if hour * HOUR > now * 1000:
                left = hour * HOUR
                break
            parts = list(parts)
            rows = np.concatenate([np.frombuffer(self.waiting.getValue(p)[0], ROW) for p in parts])
            rows = rows[np.lexsort([rows[c] for c in reversed(ROW.names)])]
            upto = int(np.searchsorted(rows["at"], now * 1000, "right"))
            if not upto:
                left = int(rows["at"][0])
                break
            for p in parts:
                self.waiting.removeKey(p)
            if upto < len(rows):
                self.waiting.updateValue(parts[0], (rows[upto:].tobytes(),))
                left = int(rows["at"][upto])
            for at in range(0, upto, SHOWN):
                for r in rows[at : min(at + SHOWN, upto)].tolist():
                    r = (*r[:5], None if r[5] != r[5] else r[5])
                    if held is not None and held[0] != r[2]:
                        self.ended(held)
                        held = None
                    held, shown = self.step((r[2], *self.fresh()) if held is None else held, r)
                    out.append((*key, r[2], r[1], *shown))
                if len(out) >= SHOWN:
                    yield self.frame(out)
                    out = []
            if left is not None:
                break
        if held is not None and (held[0] + 1) * DAY_MS <= now:  # rows that still wait are later than now
            self.ended(held)
            held = None
        if left is not None:
            self.handle.registerTimer(-(-left // 1000))
        elif places:
            self.parts.clear()
        if held is None:
            if self.open.exists():
                self.open.clear()
        else:
            self.open.update(held)
            self.handle.registerTimer((held[0] + 1) * DAY_MS)
        if out:
            yield self.frame(out)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["instrument", "day", "event_id", *self.columns]).astype({c: "Int64" for c in self.whole})

    whole: tuple[str, ...] = ()

    def fresh(self) -> tuple:
        raise NotImplementedError

    def step(self, held: tuple, row: tuple) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def ended(self, held: tuple) -> None:
        """A session is over; what outlives it may be kept."""

    def close(self) -> None:
        pass


def _change(new: float, old: float | None) -> float | None:
    return None if not old else (new - old) / old


class SessionFeatures(InOrder):
    """STR-8, STR-14, STR-18: features of each row from its session so far and from the ranges of the days before.

    EMA 9 and 21, returns over 1 and 5 rows, RSI (Wilder, 14; gains begin with 0; 100 without losses), ATR seeded by the mean of 14
    ranges, its place among the last ATRs of up to `days` sessions (5 at least), distances from VWAP and from the day's extremes,
    volume against its last 20 and as a z-score among them, structure of the last pivots (two rows on both sides).
    """

    state = (
        "n long, ema9 double, ema21 double, high double, low double, pv double, v double, gain double, loss double, ranges double, atr double, "
        "tail array<double>, volumes array<double>, highs array<double>, lows array<double>"
    )
    columns = ("bar", "ret_1", "ret_5", "ema_spread", "ema_slope", "rsi", "atr_ratio", "atr_percentile", "vwap_distance", "high_distance", "low_distance", "rel_volume", "volume_z", "structure")

    def __init__(self, n: int = 14, window: int = 20, days: int = 120):
        self.n, self.window, self.days = n, window, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.daily = handle.getListState("daily", "atr double")
        self.past: list[float] | None = None

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.past = [r[0] for r in self.daily.get()] if self.daily.exists() else []
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def ended(self, held: tuple) -> None:
        if held[11] is not None:
            self.past = [*self.past, held[11]][-self.days :]
            self.daily.put([(x,) for x in self.past])

    def fresh(self) -> tuple:
        return (0, None, None, None, None, 0.0, 0.0, None, None, 0.0, None, [], [], [], [])

    def step(self, held: tuple, row: tuple) -> tuple[tuple, tuple]:
        session, n, ema9, ema21, high, low, pv, v, gain, loss, ranges, atr, tail, volumes, highs, lows = held
        tail, volumes, highs, lows, x, volume = list(tail), list(volumes), list(highs), list(lows), row[4], row[5]
        n, before9 = n + 1, ema9
        ema9, ema21 = (x if e is None else x * (2 / (span + 1)) + e * (1 - 2 / (span + 1)) for e, span in ((ema9, 9), (ema21, 21)))
        high, low = (x, x) if high is None else (max(high, x), min(low, x))
        last = tail[-1] if tail else None
        up, down = (0.0, 0.0) if last is None else (max(x - last, 0.0), max(last - x, 0.0))
        gain, loss = (up, down) if gain is None else (gain + (up - gain) / self.n, loss + (down - loss) / self.n)
        if last is not None:
            if n <= self.n + 1:
                ranges += abs(x - last)
                atr = ranges / self.n if n == self.n + 1 else None
            else:
                atr = atr + (abs(x - last) - atr) / self.n
        tail = [*tail[-5:], x]
        if volume is not None:
            pv, v, volumes = pv + x * volume, v + volume, [*volumes[-(self.window - 1) :], volume]
        vwap = pv / v if v > 0 else None
        if len(tail) >= 5:
            five = tail[-5:]
            if five[2] == max(five):
                highs = [*highs[-1:], five[2]]
            if five[2] == min(five):
                lows = [*lows[-1:], five[2]]
        structure = "MIXED"
        if len(highs) == len(lows) == 2:
            rises, falls = highs[1] > highs[0] and lows[1] > lows[0], highs[1] < highs[0] and lows[1] < lows[0]
            structure = "HH_HL" if rises else "LH_LL" if falls else "MIXED"
        rel = z = None
        if len(volumes) >= 5 and volume is not None:
            mean = sum(volumes) / len(volumes)
            spread = (sum((y - mean) ** 2 for y in volumes) / len(volumes)) ** 0.5
            rel, z = volume / mean if mean > 0 else None, (volume - mean) / spread if spread > 0 else None
        rsi = None if n < self.n + 1 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        place = sum(p <= atr for p in self.past) / len(self.past) if atr is not None and len(self.past) >= 5 else None
        shown = (
            n, _change(x, last), _change(x, tail[-6] if len(tail) >= 6 else None), ema9 - ema21, None if before9 is None else ema9 - before9, rsi, atr / x if atr is not None and x else None, place,
            _change(x, vwap), _change(x, high), _change(x, low), rel, z, structure,
        )
        return (session, n, ema9, ema21, high, low, pv, v, gain, loss, ranges, atr, tail, volumes, highs, lows), shown


SESSION_FEATURES = (
    "instrument string, day long, event_id long, bar long, ret_1 double, ret_5 double, ema_spread double, ema_slope double, rsi double, atr_ratio double, atr_percentile double, "
    "vwap_distance double, high_distance double, low_distance double, rel_volume double, volume_z double, structure string"
)


class MorningSummary(InOrder):
    """STR-11: rows of [start, cut) are gathered; from the cut on each row of the session gets their summary."""

    state, columns, whole = "n long, first double, last double, high double, low double", ("morning_rows", "morning_change", "morning_range"), ("morning_rows",)

    def __init__(self, start: int, cut: int):
        self.start, self.cut = start, cut

    def fresh(self) -> tuple:
        return (0, None, None, None, None)

    def step(self, held: tuple, row: tuple) -> tuple[tuple, tuple]:
        session, n, first, last, high, low = held
        x = row[4]
        if self.start <= row[3] < self.cut:
            n, first, last = n + 1, x if first is None else first, x
            high, low = (x, x) if high is None else (max(high, x), min(low, x))
        shown = (n, last - first, high - low) if row[3] >= self.cut and n else (None, None, None)
        return (session, n, first, last, high, low), shown


def wall_micros(ts: str) -> Column:
    """Microseconds since 1970 by the clock on the wall, whatever the session's zone, so that days end where dates do."""
    return F.unix_micros(F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def _in_order(df: DataFrame, processor: InOrder, schema: str, ts: str, delay: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers may not have this package
    wall = wall_micros(ts)
    rows = df.select("instrument", F.timestamp_micros(wall).alias("ts"), wall.alias("at"), "event_id", F.unix_date(F.to_date(ts)).cast("long").alias("session"), (F.hour(ts) * 60 + F.minute(ts)).alias("minute"), F.col("price").cast("double"), F.col("volume").cast("double"))
    out = rows.withWatermark("ts", delay).groupBy("instrument").transformWithStateInPandas(processor, schema, "append", "EventTime")
    return out.select("instrument", F.date_from_unix_date(F.col("day").cast("int")).alias("session"), *(c for c in out.columns if c not in ("instrument", "day")))


def session_features(df: DataFrame, ts: str = "ts", delay: str = "10 minutes", **parameters: int) -> DataFrame:
    """STR-8, STR-14, STR-18: a stream of (instrument, ts, event_id, price, volume) with the features of SessionFeatures.  Rows without an
    instrument, id or price give nothing; rows later than `delay` behind the newest are dropped and counted by Spark.  State of a
    key: rows within the delay, one open session and up to 120 daily ranges."""
    return _in_order(df, SessionFeatures(**parameters), SESSION_FEATURES, ts, delay)


def morning_summary(df: DataFrame, start: int, cut: int, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """STR-11: the same stream with morning_rows, morning_change and morning_range of minutes [start, cut) on rows from the cut on."""
    return _in_order(df, MorningSummary(start, cut), "instrument string, day long, event_id long, morning_rows long, morning_change double, morning_range double", ts, delay)


def open_state(df_session, checkpoint: str, name: str) -> DataFrame:
    """Rows of a state variable after the last batch of a query, by Spark's state reader."""
    return df_session.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
