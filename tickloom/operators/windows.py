"""Window operators (WIN family).  keys: the session; order: time, then a unique tiebreak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import ColumnOrName, col, safe_divide
from .counting import earlier_counts


def over(keys: Sequence[str], order: Sequence[ColumnOrName]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def k_return(x: ColumnOrName, k: int, w: WindowSpec) -> Column:
    """WIN-1: x / x[-k] - 1, no fill."""
    return safe_divide(col(x), F.lag(col(x), k).over(w)) - 1


def k_diff(x: ColumnOrName, k: int, w: WindowSpec) -> Column:
    """WIN-2."""
    return col(x) - F.lag(col(x), k).over(w)


def rolling(fn, x: ColumnOrName, n: int, least: int, w: WindowSpec) -> Column:
    """WIN-3, WIN-4, WIN-29: an aggregate of the last n rows, null with fewer than `least` non-null values."""
    f = last_n(w, n)
    return F.when(F.count(col(x)).over(f) >= least, fn(col(x)).over(f))


def relative(x: ColumnOrName, mean: Column) -> Column:
    """WIN-5: x / mean; 0 if both are 0, null if only the mean is; null counts as 0 in the tests."""
    zero, m = F.coalesce(col(x), F.lit(0)) == 0, F.coalesce(mean, F.lit(0)) == 0
    return F.when(zero & m, 0.0).when(m, None).otherwise(col(x) / mean)


def zscore(x: ColumnOrName, n: int, least: int, w: WindowSpec) -> Column:
    """WIN-6, WIN-30: population z-score of the last n rows; 0 where deviation and spread are 0."""
    mean, sd = rolling(F.avg, x, n, least, w), rolling(F.stddev_pop, x, n, least, w)
    return F.when((sd == 0) & (col(x) == mean), 0.0).when(sd == 0, None).otherwise((col(x) - mean) / sd)


def extremes(x: ColumnOrName, w: WindowSpec) -> tuple[Column, Column]:
    """WIN-7: running maximum and minimum."""
    return F.max(col(x)).over(running(w)), F.min(col(x)).over(running(w))


def vwap(price: ColumnOrName, volume: ColumnOrName, w: WindowSpec, drop_empty: bool = False, when: Column | None = None) -> Column:
    """WIN-8, WIN-9: running volume-weighted price.  Null volume is 0, or rows without volume are left out
    (drop_empty: null until the first valid row).  when: rows that count, for an anchored start."""
    v = F.coalesce(col(volume), F.lit(0))
    if drop_empty:
        v = F.when(col(volume) > 0, col(volume))
    if when is not None:
        v = F.when(when, v)
    return safe_divide(F.sum(col(price) * v).over(running(w)), F.sum(F.when(col(price).isNotNull(), v)).over(running(w)))


def expanding_mean(x: ColumnOrName, least: int, w: WindowSpec) -> Column:
    """WIN-10."""
    return F.when(F.count(col(x)).over(running(w)) >= least, F.avg(col(x)).over(running(w)))


def expanding_rank(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str], out: str, least: int = 5) -> DataFrame:
    """WIN-11: (#less + (#equal + 1) / 2) / n among the rows up to this one, nulls left out.

    A session is in one task; its time grows with n log n.
    """
    df = earlier_counts(df, x, keys, order)
    n = F.col("_n") + 1
    return df.withColumn(out, F.when(F.col(x).isNotNull() & (n >= least), (F.col("_less") + (F.col("_same") + 2) / 2) / n)).drop("_less", "_same", "_n")


def history_percentile(df: DataFrame, x: str, keys: Sequence[str], day: str, order: Sequence[str], out: str, days: int = 90) -> DataFrame:
    """WIN-12 by days: 100 * share of earlier values <= x, over the days before (within `days` of them) and the earlier rows of the
    day.  counting.history_percentile_rows has a history of a number of rows, and sends each row to two blocks only.

    The distinct values of a day, with counts, go to each of the `days` days after it, and meet that
    day's own values in one pass in order of value that adds the counts up: a day's rows are never
    paired with another's.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, day, F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    later = counts.select(*keys, F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, days))).alias(day), "_x", "_c", F.lit(0).alias("_own"))
    both = later.join(counts.select(*keys, day).distinct(), [*keys, day], "left_semi").unionByName(counts.withColumn("_c", F.lit(0).cast("long")).withColumn("_own", F.lit(1)))
    day_of = Window.partitionBy(*keys, day)
    upto = day_of.orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    past = both.withColumn("_le", F.sum("_c").over(upto)).withColumn("_all", F.sum("_c").over(day_of)).where("_own = 1").drop("_c", "_own")
    rows = earlier_counts(df, x, [*keys, day], order)
    on = [rows[k].eqNullSafe(past[k]) for k in (*keys, day)] + [rows[x] == past["_x"]]
    joined = rows.join(past, on, "left").select(*(rows[c] for c in rows.columns), "_le", "_all")
    total = F.coalesce("_all", F.lit(0)) + F.col("_n")
    seen = F.coalesce("_le", F.lit(0)) + F.col("_less") + F.col("_same")
    return joined.withColumn(out, F.when(F.col(x).isNotNull() & (total > 0), 100.0 * seen / total)).drop("_le", "_all", "_less", "_same", "_n")


def clock_baseline(x: ColumnOrName, keys: Sequence[str], clock: str, day_index: str, lookback: int = 30) -> Column:
    """WIN-13: mean at the same clock slot over the earlier days of the lookback."""
    return F.avg(col(x)).over(Window.partitionBy(*keys, clock).orderBy(day_index).rangeBetween(-lookback, -1))


def day_index(df: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """WIN-17: (keys, day, day_idx): dense index of the observed days; one row per day."""
    days = df.select(*keys, day).distinct()
    return days.withColumn("day_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1)


def previous_levels(daily: DataFrame, keys: Sequence[str], day: str, week: int = 5) -> DataFrame:
    """WIN-14: previous day's high, low, close and the extremes of the `week` days before; daily has one row per day."""
    w = over(keys, [day])
    back = w.rowsBetween(-week, -1)
    return daily.withColumns(
        {"prev_high": F.lag("high").over(w), "prev_low": F.lag("low").over(w), "prev_close": F.lag("close").over(w), "week_high": F.max("high").over(back), "week_low": F.min("low").over(back), "gap": F.col("open") - F.lag("close").over(w)}
    )


def lagged_daily(daily: DataFrame, columns: Sequence[str], keys: Sequence[str], day: str) -> DataFrame:
    """WIN-15, WIN-16: each column holds the day before's value."""
    return daily.withColumns({c: F.lag(c).over(over(keys, [day])) for c in columns})


def daily_regime(daily: DataFrame, keys: Sequence[str], day: str, close: str = "close", window: int = 10, long: int = 60, log: bool = False) -> DataFrame:
    """WIN-18: annualised volatility of daily returns, distance to and slope of the mean, long return."""
    w = over(keys, [day])
    ret = F.ln(F.col(close) / F.lag(close).over(w)) if log else k_return(close, 1, w)
    df = daily.withColumn("ret", ret)
    mean = rolling(F.avg, close, window, window, w)
    df = df.withColumn("mean", mean).withColumn("vol", rolling(F.stddev_samp, "ret", window, window, w) * 252**0.5)
    return df.withColumn("dist", safe_divide("close", "mean") - 1).withColumn("mean_slope", safe_divide("mean", F.lag("mean", 5).over(w)) - 1).withColumn("long_ret", k_return(close, long, w))


def win_shares(daily: DataFrame, a: str, b: str, days: int, keys: Sequence[str], day: str) -> DataFrame:
    """WIN-19: shares of a and b in the days before; at least half the window, one at least."""
    w = over(keys, [day]).rowsBetween(-days, -1)
    enough = F.count(a).over(w) >= max(1, days // 2)
    sa, sb = F.sum(a).over(w), F.sum(b).over(w)
    return daily.withColumn("share_a", F.when(enough, safe_divide(sa, sa + sb))).withColumn("share_diff", F.when(enough, safe_divide(sa - sb, sa + sb)))


def trailing_sessions(x: str, keys: Sequence[str], day: str, n: int = 20) -> tuple[Column, Column]:
    """WIN-20: mean of the n sessions before and the value of the one before."""
    w = over(keys, [day])
    return F.avg(x).over(w.rowsBetween(-n, -1)), F.lag(x).over(w)


def opening_range(df: DataFrame, keys: Sequence[str], minute: str, high: str, low: str, close: str, order: Sequence[str], start: int, minutes: int = 15, inclusive: bool = False) -> DataFrame:
    """WIN-21, WIN-22: high and low of the first minutes (inclusive: also the bar at start + minutes), whether they are
    over, breakouts per bar and latched."""
    inside = (F.col(minute) <= start + minutes) if inclusive else (F.col(minute) < start + minutes)
    whole = Window.partitionBy(*keys)
    df = df.withColumn("or_high", F.max(F.when(inside, F.col(high))).over(whole)).withColumn("or_low", F.min(F.when(inside, F.col(low))).over(whole))
    df = df.withColumn("or_ready", ~inside)
    df = df.withColumn("break_up", F.col("or_ready") & (F.col(close) > F.col("or_high"))).withColumn("break_down", F.col("or_ready") & (F.col(close) < F.col("or_low")))
    w = running(over(keys, order))
    return df.withColumn("broke_up", F.bool_or("break_up").over(w)).withColumn("broke_down", F.bool_or("break_down").over(w))


def bars_since_first(df: DataFrame, cond: Column, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """WIN-23: rows since the condition first held, null before."""
    w = over(keys, order)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn("_c", cond)
    return df.withColumn(out, F.col("_n") - F.min(F.when(F.col("_c"), F.col("_n"))).over(running(w))).drop("_n", "_c")


def same_as_previous(key: str, expr: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """WIN-26: the expression where the key is as in the row before."""
    return F.when(F.col(key) == F.lag(key).over(over(keys, order)), expr)


def forward_fill(df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """WIN-27: last value of the session, never backward."""
    w = running(over(keys, order))
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def forward_extremes(high: ColumnOrName, low: ColumnOrName, h: int, w: WindowSpec) -> tuple[Column, Column]:
    """WIN-32: maximum high and minimum low of the next h rows; null without any."""
    f = w.rowsBetween(1, h)
    return F.max(col(high)).over(f), F.min(col(low)).over(f)


def swing(high: ColumnOrName, low: ColumnOrName, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """WIN-33: extremes of the last n bars and this one."""
    f = w.rowsBetween(-n, 0)
    return F.max(col(high)).over(f), F.min(col(low)).over(f)


def pivots(df: DataFrame, high: str, low: str, keys: Sequence[str], order: Sequence[str], k: int = 2) -> DataFrame:
    """WIN-34: pivot rows (extreme of k bars on both sides, both sides whole) and whether pivots rise or fall: HH_HL,
    LH_LL, MIXED from the last two pivots of either kind up to the row."""
    w = over(keys, order)
    f = w.rowsBetween(-k, k)
    whole = F.count("*").over(f) == 2 * k + 1
    df = df.withColumn("pivot_high", F.when(whole & (F.col(high) == F.max(high).over(f)), F.col(high))).withColumn("pivot_low", F.when(whole & (F.col(low) == F.min(low).over(f)), F.col(low)))
    seen, before = w.rowsBetween(Window.unboundedPreceding, -k), w.rowsBetween(Window.unboundedPreceding, -1)
    for c in ("high", "low"):  # each pivot knows the one before it
        df = df.withColumn(f"_{c}", F.when(F.col(f"pivot_{c}").isNotNull(), F.struct(F.col(f"pivot_{c}").alias("at"), F.last(f"pivot_{c}", ignorenulls=True).over(before).alias("prev"))))
        df = df.withColumn(f"_{c}", F.last(f"_{c}", ignorenulls=True).over(seen))
    up = (F.col("_high.at") > F.col("_high.prev")) & (F.col("_low.at") > F.col("_low.prev"))
    down = (F.col("_high.at") < F.col("_high.prev")) & (F.col("_low.at") < F.col("_low.prev"))
    return df.withColumn("structure", F.when(up, "HH_HL").when(down, "LH_LL").otherwise("MIXED")).drop("_high", "_low")


def breakout_state(high: str, low: str, close: str, n: int, w: WindowSpec) -> Column:
    """WIN-35: BREAKOUT_UP / _DOWN beyond the n bars before, FAKEOUT_UP / _DOWN if only the wick was, else INSIDE."""
    f = w.rowsBetween(-n, -1)
    hi, lo = F.max(high).over(f), F.min(low).over(f)
    return F.when(F.col(close) > hi, "BREAKOUT_UP").when(F.col(close) < lo, "BREAKOUT_DOWN").when(F.col(high) > hi, "FAKEOUT_UP").when(F.col(low) < lo, "FAKEOUT_DOWN").when(hi.isNotNull(), "INSIDE")


def position_in_range(x: str, w: WindowSpec) -> Column:
    """WIN-36: place of x in the running range, 0 to 1; null while the range is a point."""
    hi, lo = extremes(x, w)
    return F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(x) - lo) / (hi - lo))))


def overlap_ratio(high: str, low: str, w: WindowSpec) -> Column:
    """WIN-37: share of the bar's range that the bar before covers."""
    ph, pl = F.lag(high).over(w), F.lag(low).over(w)
    shared = F.greatest(F.lit(0.0), F.least(F.col(high), ph) - F.greatest(F.col(low), pl))
    return F.when(ph.isNotNull() & pl.isNotNull(), safe_divide(shared, F.col(high) - F.col(low)))


def compression(x: str, w: WindowSpec, short: int = 15, long: int = 26) -> Column:
    """WIN-38: mean of the last `short` rows over the mean of the `long` rows before them."""
    return safe_divide(F.avg(x).over(w.rowsBetween(-(short - 1), 0)), F.avg(x).over(w.rowsBetween(-(short + long - 1), -short)))


def islands(df: DataFrame, same: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """WIN-39: number the runs of rows that agree on `same` (nulls agree); column island."""
    w = over(keys, order)
    changed = ~F.struct(*(F.col(c) for c in same)).eqNullSafe(F.lag(F.struct(*(F.col(c) for c in same))).over(w))
    df = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(changed.cast("int")))
    return df.withColumn("island", F.sum("_new").over(running(w))).drop("_new")


def collapse_runs(df: DataFrame, same: Sequence[str], keys: Sequence[str], order: Sequence[str], ts: str) -> DataFrame:
    """WIN-39: a row for each run: the shared values, first and last time, length."""
    runs = islands(df, same, keys, order).groupBy(*keys, "island")
    return runs.agg(*(F.first(c).alias(c) for c in same), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("run_length"))


def cutoff_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, back: Sequence[int] = (1, 2, 3), least: int = 3) -> DataFrame:
    """WIN-40: per session, from the rows given (those up to the cut-off): first and last value, changes over the last k
    rows, their rates per row, second differences, range and direction; all null with fewer rows than `least`."""
    sorted_ = F.array_sort(F.collect_list(F.struct(*map(F.col, order), F.col(x).alias("_x"))))
    g = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.transform(sorted_, lambda s: s["_x"]).alias("v"))
    enough = F.size("v") >= least
    at = lambda i: F.try_element_at("v", F.lit(i))
    cols = {"n_rows": F.size("v"), "first_value": at(1), "last_value": at(-1)}
    for k in back:
        cols[f"change_{k}"] = at(-1) - at(-1 - k)
        cols[f"rate_{k}"] = (at(-1) - at(-1 - k)) / k
        cols[f"accel_{k}"] = (at(-1) - at(-1 - k)) - (at(-1 - k) - at(-1 - 2 * k))
    cols["value_range"] = F.array_max("v") - F.array_min("v")
    cols["direction"] = F.signum(at(-1) - at(1))
    return g.select(*keys, *(F.when(enough, c).alias(n) if n != "n_rows" else c.alias(n) for n, c in cols.items()))
