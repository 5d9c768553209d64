"""Queries of the window and scan operators on bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import scans as C
from ..operators import windows as W
from ..operators.counting import history_percentile_rows
from .catalogue import query, r6, rounded
from .views import BARS, DAILY, HOURLY, KEYS, NUMBERED, ORDER, bars, daily, hourly

_W = "(PARTITION BY session, instrument ORDER BY ts, event_id)"
_WIN = "WINDOW w AS (PARTITION BY session, instrument ORDER BY ts, event_id)"
ID = ["session", "instrument", "event_id"]


@query(
    "agg_1_hourly_bars_with_vwap",
    "WITH " + HOURLY + """ SELECT session, instrument, hr, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, n,
  round(sum(close * volume) OVER x / nullif(sum(volume) OVER x, 0), 6) AS vwap, round(max(high) OVER x - close, 6) AS from_high
FROM hourly WINDOW x AS (PARTITION BY session, instrument ORDER BY hr)""",
)
def hourly_bars(spark: SparkSession, sf: str) -> DataFrame:
    x = W.over(KEYS, ["hr"])
    h = hourly(spark, sf)
    h = h.withColumn("vwap", W.vwap("close", "volume", x)).withColumn("from_high", F.max("high").over(W.running(x)) - F.col("close"))
    return rounded(h)


@query(
    "win_1_to_10_running_and_rolling",
    "WITH " + BARS + f""" SELECT session, instrument, event_id, round(price / nullif(lag(price) OVER w, 0) - 1, 6) AS ret1, round(price - lag(price, 5) OVER w, 6) AS diff5,
  round(CASE WHEN count(price) OVER w20 >= 5 THEN avg(price) OVER w20 END, 6) AS mean20, round(CASE WHEN count(price) OVER w20 >= 5 THEN stddev_pop(price) OVER w20 END, 6) AS sd20,
  round(CASE WHEN count(price) OVER w20 >= 5 THEN stddev_samp(price) OVER w20 END, 6) AS sds20,
  round(CASE WHEN count(volume) OVER w20 >= 5 THEN volume / nullif(avg(volume) OVER w20, 0) END, 6) AS rel_volume,
  round(max(price) OVER w - price, 6) AS from_high, round(price - min(price) OVER w, 6) AS from_low,
  round(sum(price * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) AS vwap, round(CASE WHEN count(price) OVER w >= 20 THEN avg(price) OVER w END, 6) AS mean_so_far,
  row_number() OVER w - 1 AS bar, CASE WHEN count(*) OVER w20 >= 1 THEN sum(volume) OVER w5 END::BIGINT AS volume5
FROM bars WINDOW w AS {_W}, w20 AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS 19 PRECEDING), w5 AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS 4 PRECEDING)""",
)
def running_and_rolling(spark: SparkSession, sf: str) -> DataFrame:
    w = W.over(KEYS, ORDER)
    mean_v = W.rolling(F.avg, "volume", 20, 5, w)
    hi, lo = W.extremes("price", w)
    return bars(spark, sf).select(
        *ID, *r6(ret1=W.k_return("price", 1, w), diff5=W.k_diff("price", 5, w), mean20=W.rolling(F.avg, "price", 20, 5, w), sd20=W.rolling(F.stddev_pop, "price", 20, 5, w), sds20=W.rolling(F.stddev_samp, "price", 20, 5, w),
                 rel_volume=F.when(mean_v.isNotNull(), W.relative("volume", mean_v)), from_high=hi - F.col("price"), from_low=F.col("price") - lo, vwap=W.vwap("price", "volume", w), mean_so_far=W.expanding_mean("price", 20, w)),
        (F.row_number().over(w) - 1).cast("long").alias("bar"), W.rolling(F.sum, "volume", 5, 1, w).alias("volume5"),
    )


@query(
    "win_6_30_zscore",
    "WITH " + BARS + """, x AS (SELECT *, count(*) OVER v AS c, avg(price) OVER v AS m, stddev_pop(price) OVER v AS s FROM bars WINDOW v AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS 9 PRECEDING))
SELECT session, instrument, event_id, round(CASE WHEN c < 5 THEN NULL WHEN s = 0 AND price = m THEN 0.0 WHEN s = 0 THEN NULL ELSE (price - m) / s END, 6) AS z FROM x""",
)
def zscores(spark: SparkSession, sf: str) -> DataFrame:
    w = W.over(KEYS, ORDER)
    return bars(spark, sf).select(*ID, *r6(z=W.zscore("price", 10, 5, w)))


@query(
    "win_9_anchored_vwap",
    "WITH " + BARS + """ SELECT session, instrument, event_id, round(sum(CASE WHEN hour(ts) >= 9 AND volume > 0 THEN price * volume END) OVER w / nullif(sum(CASE WHEN hour(ts) >= 9 AND volume > 0 THEN volume END) OVER w, 0), 6) AS anchored
FROM bars """ + _WIN,
)
def anchored(spark: SparkSession, sf: str) -> DataFrame:
    w = W.over(KEYS, ORDER)
    return bars(spark, sf).select(*ID, *r6(anchored=W.vwap("price", "volume", w, drop_empty=True, when=F.hour("ts") >= 9)))


@query(
    "win_11_expanding_rank",
    "WITH " + NUMBERED + """ SELECT a.session, a.instrument, a.event_id, round(CASE WHEN count(*) >= 5 THEN (count(*) FILTER (b.price < a.price) + (count(*) FILTER (b.price = a.price) + 1) / 2.0) / count(*) END, 6) AS pct_rank
FROM b a JOIN b ON a.session = b.session AND a.instrument = b.instrument AND b.rn <= a.rn GROUP BY ALL""",
)
def expanding_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.expanding_rank(bars(spark, sf), "price", KEYS, ORDER, "pct_rank"), *ID, "pct_rank")


@query(
    "win_12_history_percentile",
    "WITH " + NUMBERED + """ SELECT a.instrument, a.session, a.event_id, round(100.0 * count(b.price) FILTER (b.price <= a.price) / nullif(count(b.price), 0), 6) AS pct
FROM b a LEFT JOIN b ON a.instrument = b.instrument AND (b.session < a.session AND b.session >= a.session - 90 OR b.session = a.session AND b.rn < a.rn) GROUP BY ALL""",
)
def history_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.history_percentile(bars(spark, sf), "price", ["instrument"], "session", ORDER, "pct"), "instrument", "session", "event_id", "pct")


def _past_rows(n: int) -> str:
    return "WITH " + BARS + f""", h AS (SELECT *, list(price) OVER (PARTITION BY instrument ORDER BY session, ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS past FROM bars)
SELECT instrument, session, event_id, round(CASE WHEN len(past) > 0 THEN 100.0 * len(list_filter(past, lambda p: p <= price)) / len(past) END, 6) AS pct FROM h"""


@query("win_12_history_of_30000_rows", _past_rows(30_000))
def history_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each price among the 30,000 of its instrument before it, whatever their day."""
    return rounded(history_percentile_rows(bars(spark, sf), "price", ["instrument"], "session", ORDER, "pct"), "instrument", "session", "event_id", "pct")


@query("win_12_history_of_300_rows", _past_rows(300))
def short_history(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a history that most rows have lost some of."""
    return rounded(history_percentile_rows(bars(spark, sf), "price", ["instrument"], "session", ORDER, "pct", 300), "instrument", "session", "event_id", "pct")


@query(
    "win_13_clock_baseline",
    "WITH " + HOURLY + """, d AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS day_idx FROM (SELECT DISTINCT session FROM hourly))
SELECT instrument, session, hr, round(volume / nullif(avg(volume) OVER (PARTITION BY instrument, hr ORDER BY day_idx RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING), 0), 6) AS rel FROM hourly JOIN d USING (session)""",
)
def clock_baseline(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf)
    h = h.join(W.day_index(h, "session"), "session")
    return h.select("instrument", "session", "hr", *r6(rel=S.safe_divide("volume", W.clock_baseline("volume", ["instrument"], "hr", "day_idx"))))


@query(
    "win_14_to_16_previous_levels",
    "WITH " + DAILY + """ SELECT instrument, session, round(lag(high) OVER w, 6) AS prev_high, round(lag(low) OVER w, 6) AS prev_low, round(lag(close) OVER w, 6) AS prev_close,
  round(max(high) OVER v, 6) AS week_high, round(min(low) OVER v, 6) AS week_low, round(open - lag(close) OVER w, 6) AS gap, (lag(volume) OVER w)::BIGINT AS prev_volume
FROM daily WINDOW w AS (PARTITION BY instrument ORDER BY session), v AS (PARTITION BY instrument ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def previous_levels(spark: SparkSession, sf: str) -> DataFrame:
    d = W.previous_levels(daily(spark, sf), ["instrument"], "session")
    d = W.lagged_daily(d.withColumn("prev_volume", F.col("volume")), ["prev_volume"], ["instrument"], "session")
    return rounded(d, "instrument", "session", "prev_high", "prev_low", "prev_close", "week_high", "week_low", "gap", "prev_volume")


@query(
    "win_17_latest_sessions",
    "WITH " + BARS + """, d AS (SELECT session, dense_rank() OVER (ORDER BY session) - 1 AS day_idx, count(*) AS n FROM bars GROUP BY session)
SELECT a.session, a.day_idx, sum(b.n)::BIGINT AS rows_5d FROM d a JOIN d b ON b.day_idx BETWEEN a.day_idx - 4 AND a.day_idx GROUP BY ALL""",
)
def latest_sessions(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    d = b.groupBy("session").agg(F.count("*").alias("n")).join(W.day_index(b, "session"), "session")
    return d.select("session", F.col("day_idx").cast("long"), F.sum("n").over(W.Window.orderBy("day_idx").rangeBetween(-4, 0)).alias("rows_5d"))


@query(
    "win_18_daily_regime",
    "WITH " + DAILY + """, a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, CASE WHEN count(*) OVER v = 10 THEN avg(close) OVER v END AS mean, close / nullif(lag(close, 20) OVER w, 0) - 1 AS long_ret
  FROM daily WINDOW w AS (PARTITION BY instrument ORDER BY session), v AS (PARTITION BY instrument ORDER BY session ROWS 9 PRECEDING))
SELECT instrument, session, round(ret, 6) AS ret, round(mean, 6) AS mean, round(CASE WHEN count(ret) OVER v >= 10 THEN stddev_samp(ret) OVER v END * sqrt(252), 6) AS vol, round(close / nullif(mean, 0) - 1, 6) AS dist,
  round(mean / nullif(lag(mean, 5) OVER w, 0) - 1, 6) AS mean_slope, round(long_ret, 6) AS long_ret FROM a WINDOW w AS (PARTITION BY instrument ORDER BY session), v AS (PARTITION BY instrument ORDER BY session ROWS 9 PRECEDING)""",
)
def daily_regime(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.daily_regime(daily(spark, sf), ["instrument"], "session", long=20), "instrument", "session", "ret", "mean", "vol", "dist", "mean_slope", "long_ret")


@query(
    "win_19_20_trailing_shares",
    "WITH " + BARS + """, d AS (SELECT instrument, session, count(*) FILTER (price > 10) AS a, count(*) FILTER (price <= 10) AS b, last(price ORDER BY ts, event_id) AS x FROM bars GROUP BY ALL)
SELECT instrument, session, round(CASE WHEN count(a) OVER v >= 2 THEN sum(a) OVER v / nullif(sum(a) OVER v + sum(b) OVER v, 0) END, 6) AS share_a,
  round(CASE WHEN count(a) OVER v >= 2 THEN (sum(a) OVER v - sum(b) OVER v) / nullif(sum(a) OVER v + sum(b) OVER v, 0) END, 6) AS share_diff,
  round(avg(x) OVER u, 6) AS mean20, round(lag(x) OVER w, 6) AS prev FROM d
WINDOW w AS (PARTITION BY instrument ORDER BY session), v AS (PARTITION BY instrument ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), u AS (PARTITION BY instrument ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
)
def trailing_shares(spark: SparkSession, sf: str) -> DataFrame:
    d = bars(spark, sf).groupBy("instrument", "session").agg(F.count_if(F.col("price") > 10).alias("a"), F.count_if(F.col("price") <= 10).alias("b"), F.max_by("price", F.struct(*ORDER)).alias("x"))
    d = W.win_shares(d, "a", "b", 5, ["instrument"], "session")
    mean, prev = W.trailing_sessions("x", ["instrument"], "session")
    return d.select("instrument", "session", *r6(share_a="share_a", share_diff="share_diff", mean20=mean, prev=prev))


@query(
    "win_21_22_opening_range",
    "WITH " + HOURLY + """, x AS (SELECT *, max(high) FILTER (hr < 3) OVER p AS or_high, min(low) FILTER (hr < 3) OVER p AS or_low FROM hourly WINDOW p AS (PARTITION BY session, instrument)),
y AS (SELECT *, hr >= 3 AND close > or_high AS bu, hr >= 3 AND close < or_low AS bd FROM x)
SELECT session, instrument, hr, round(or_high, 6) AS or_high, round(or_low, 6) AS or_low, bu AS break_up, bd AS break_down, bool_or(bu) OVER q AS broke_up, bool_or(bd) OVER q AS broke_down
FROM y WINDOW q AS (PARTITION BY session, instrument ORDER BY hr)""",
)
def opening_range(spark: SparkSession, sf: str) -> DataFrame:
    h = W.opening_range(hourly(spark, sf), KEYS, "hr", "high", "low", "close", ["hr"], 0, 3)
    return rounded(h, "session", "instrument", "hr", "or_high", "or_low", "break_up", "break_down", "broke_up", "broke_down")


@query(
    "win_23_bars_since_first",
    "WITH " + NUMBERED + f" SELECT session, instrument, event_id, (rn - min(CASE WHEN price > 30 THEN rn END) OVER {_W})::INTEGER AS since FROM b",
)
def bars_since(spark: SparkSession, sf: str) -> DataFrame:
    return W.bars_since_first(bars(spark, sf), F.col("price") > 30, KEYS, ORDER, "since").select(*ID, "since")


@query(
    "win_24_to_27_guards_and_fill",
    "WITH " + BARS + """, x AS (SELECT *, CASE WHEN volume > 50 THEN price END AS seen, floor(price / 10)::BIGINT AS k FROM bars)
SELECT session, instrument, event_id, round(lag(price, 3) OVER w, 6) AS back3, round(avg(price) OVER v, 6) AS key_mean, round(CASE WHEN k = lag(k) OVER w THEN price - lag(price) OVER w END, 6) AS guarded,
  round(last_value(seen IGNORE NULLS) OVER w, 6) AS filled FROM x WINDOW w AS """ + _W + ", v AS (PARTITION BY instrument, k ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)",
)
def guards_and_fill(spark: SparkSession, sf: str) -> DataFrame:
    w = W.over(KEYS, ORDER)
    b = bars(spark, sf).withColumn("seen", F.when(F.col("volume") > 50, F.col("price"))).withColumn("k", F.floor(F.col("price") / 10))
    b = W.forward_fill(b, ["seen"], KEYS, ORDER)
    key_mean = F.avg("price").over(W.over(["instrument", "k"], ORDER).rowsBetween(-30, -1))
    return b.select(*ID, *r6(back3=F.lag("price", 3).over(w), key_mean=key_mean, guarded=W.same_as_previous("k", W.k_diff("price", 1, w), KEYS, ORDER), filled="seen"))


@query(
    "win_31_net_flow",
    "WITH " + BARS + """, x AS (SELECT *, sum(CASE WHEN price >= 10 AND volume >= 50 THEN volume ELSE 0 END) OVER v AS buys, sum(CASE WHEN price < 10 AND volume >= 50 THEN volume ELSE 0 END) OVER v AS sells
  FROM bars WINDOW v AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS 4 PRECEDING))
SELECT session, instrument, event_id, CASE WHEN buys = 0 AND sells = 0 THEN NULL ELSE buys - sells END::BIGINT AS net_flow FROM x""",
)
def net_flow(spark: SparkSession, sf: str) -> DataFrame:
    w = W.over(KEYS, ORDER)
    big = F.col("volume") >= 50
    side = S.print_side("price", F.lit(10.0))
    flow = lambda s: F.sum(F.when(big & (side == s), F.col("volume")).otherwise(0)).over(W.last_n(w, 5))
    b = bars(spark, sf).withColumn("buys", flow("BUY")).withColumn("sells", flow("SELL"))
    return b.select(*ID, F.when((F.col("buys") != 0) | (F.col("sells") != 0), F.col("buys") - F.col("sells")).alias("net_flow"))


@query(
    "win_32_33_forward_and_swing",
    "WITH " + BARS + """ SELECT session, instrument, event_id, round(max(price) OVER f, 6) AS fmax, round(min(price) OVER f, 6) AS fmin, round(max(price) OVER s, 6) AS swing_high, round(min(price) OVER s, 6) AS swing_low FROM bars
WINDOW f AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), s AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)""",
)
def forward_and_swing(spark: SparkSession, sf: str) -> DataFrame:
    w = W.over(KEYS, ORDER)
    up, down = W.forward_extremes("price", "price", 5, w)
    hi, lo = W.swing("price", "price", 8, w)
    return bars(spark, sf).select(*ID, *r6(fmax=up, fmin=down, swing_high=hi, swing_low=lo))


@query(
    "win_34_pivots",
    "WITH " + NUMBERED + """, p AS (SELECT *, CASE WHEN count(*) OVER f = 5 AND price = max(price) OVER f THEN price END AS ph, CASE WHEN count(*) OVER f = 5 AND price = min(price) OVER f THEN price END AS pl
  FROM b WINDOW f AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
q AS (SELECT *, list(ph) FILTER (ph IS NOT NULL) OVER s AS hs, list(pl) FILTER (pl IS NOT NULL) OVER s AS ls FROM p WINDOW s AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING))
SELECT session, instrument, event_id, round(ph, 6) AS pivot_high, round(pl, 6) AS pivot_low,
  CASE WHEN hs[-1] > hs[-2] AND ls[-1] > ls[-2] THEN 'HH_HL' WHEN hs[-1] < hs[-2] AND ls[-1] < ls[-2] THEN 'LH_LL' ELSE 'MIXED' END AS structure FROM q""",
)
def pivots(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.pivots(bars(spark, sf), "price", "price", KEYS, ORDER), *ID, "pivot_high", "pivot_low", "structure")


@query(
    "win_35_to_38_structure",
    "WITH " + HOURLY + """, x AS (SELECT *, max(high) OVER f AS ph, min(low) OVER f AS pl, max(close) OVER w AS hi, min(close) OVER w AS lo, lag(high) OVER w AS lh, lag(low) OVER w AS ll,
  avg(high - low) OVER s AS a, avg(high - low) OVER l AS c FROM hourly WINDOW w AS (PARTITION BY session, instrument ORDER BY hr), f AS (PARTITION BY session, instrument ORDER BY hr ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
  s AS (PARTITION BY session, instrument ORDER BY hr ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), l AS (PARTITION BY session, instrument ORDER BY hr ROWS BETWEEN 7 PRECEDING AND 3 PRECEDING))
SELECT session, instrument, hr, CASE WHEN close > ph THEN 'BREAKOUT_UP' WHEN close < pl THEN 'BREAKOUT_DOWN' WHEN high > ph THEN 'FAKEOUT_UP' WHEN low < pl THEN 'FAKEOUT_DOWN' WHEN ph IS NOT NULL THEN 'INSIDE' END AS state,
  round(CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (close - lo) / (hi - lo))) END, 6) AS place, round(CASE WHEN high > low AND lh IS NOT NULL THEN greatest(0.0, least(high, lh) - greatest(low, ll)) / (high - low) END, 6) AS overlap,
  round(a / nullif(c, 0), 6) AS compression FROM x""",
)
def structure(spark: SparkSession, sf: str) -> DataFrame:
    x = W.over(KEYS, ["hr"])
    h = hourly(spark, sf).withColumn("tr", F.col("high") - F.col("low"))
    overlap = W.overlap_ratio("high", "low", x)
    return h.select("session", "instrument", "hr", W.breakout_state("high", "low", "close", 4, x).alias("state"), *r6(place=W.position_in_range("close", x), overlap=overlap, compression=W.compression("tr", x, 3, 5)))


@query(
    "win_39_collapsed_runs",
    "WITH " + BARS + """, x AS (SELECT *, floor(price / 10)::BIGINT AS band, CASE WHEN floor(price / 10) IS DISTINCT FROM lag(floor(price / 10)) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM bars WINDOW w AS """ + _W + """),
y AS (SELECT *, sum(new) OVER w AS g FROM x WINDOW w AS """ + _W + """)
SELECT session, instrument, g::BIGINT AS island, first(band) AS band, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS run_length FROM y GROUP BY session, instrument, g""",
)
def collapsed_runs(spark: SparkSession, sf: str) -> DataFrame:
    return W.collapse_runs(bars(spark, sf).withColumn("band", F.floor(F.col("price") / 10)), ["band"], KEYS, ORDER, "ts")


@query(
    "win_40_cutoff_features",
    "WITH " + BARS + """, v AS (SELECT session, instrument, list(price ORDER BY ts, event_id) AS v FROM bars WHERE hour(ts) < 12 GROUP BY ALL)
SELECT session, instrument, len(v)::INTEGER AS n_rows, """ + ", ".join(f"round(CASE WHEN len(v) >= 3 THEN {c} END, 6) AS {n}" for n, c in {"first_value": "v[1]", "last_value": "v[-1]", "change_1": "v[-1] - v[-2]", "rate_2": "(v[-1] - v[-3]) / 2", "accel_1": "v[-1] - v[-2] - (v[-2] - v[-3])", "value_range": "list_max(v) - list_min(v)", "direction": "sign(v[-1] - v[1])::DOUBLE"}.items()) + " FROM v",
)
def cutoff(spark: SparkSession, sf: str) -> DataFrame:
    c = W.cutoff_features(bars(spark, sf).where(F.hour("ts") < 12), KEYS, ORDER, "price")
    return rounded(c, *KEYS, "n_rows", "first_value", "last_value", "change_1", "rate_2", "accel_1", "value_range", "direction")


# ---------------------------------------------------------------- scans: the SQL folds each row's prefix

_PREFIX = NUMBERED + f", p AS (SELECT *, list(price) OVER {_W} AS v, lag(price) OVER {_W} AS prev FROM b)"


def _ewm_sql(v: str, a: float) -> str:
    return f"list_reduce({v}, lambda y, x: y * {1 - a!r} + x * {a!r})"


@query("scn_1_ewm", "WITH " + _PREFIX + f" SELECT session, instrument, event_id, round({_ewm_sql('v', 0.2)}, 6) AS ema9, round(CASE WHEN rn >= 5 THEN {_ewm_sql('v', 2 / 22)} END, 6) AS ema21 FROM p")
def ewm(spark: SparkSession, sf: str) -> DataFrame:
    b = C.ewm(bars(spark, sf), "price", KEYS, ORDER, "ema9", span=9)
    return rounded(C.ewm(b, "price", KEYS, ORDER, "ema21", span=21, least=5), *ID, "ema9", "ema21")


@query("scn_1_ewm_across_sessions")
def ewm_long(spark: SparkSession, sf: str) -> DataFrame:
    """The mean runs on over all sessions; SQL would fold every row's whole past, so tests hold it against brute force."""
    return rounded(C.ewm_long(bars(spark, sf), "price", ["instrument"], "session", ORDER, "ema", 0.2), "instrument", "session", "event_id", "ema")


@query(
    "scn_2_rsi",
    "WITH " + NUMBERED + f", d AS (SELECT *, price - lag(price) OVER {_W} AS d FROM b), p AS (SELECT *, list(greatest(d, 0.0)) FILTER (d IS NOT NULL) OVER {_W} AS g, list(greatest(-d, 0.0)) FILTER (d IS NOT NULL) OVER {_W} AS l FROM d), "
    + f"e AS (SELECT *, {_ewm_sql('g', 1 / 14)} AS eg, {_ewm_sql('l', 1 / 14)} AS el FROM p WHERE rn > 1) SELECT b.session, b.instrument, b.event_id, round(CASE WHEN e.rn > 14 AND el > 0 THEN 100 - 100 / (1 + eg / el) END, 6) AS rsi FROM b LEFT JOIN e USING (session, instrument, event_id)",
)
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.rsi(bars(spark, sf), "price", KEYS, ORDER), *ID, "rsi")


_TR = HOURLY + ", t AS (SELECT *, row_number() OVER h AS rn, greatest(high - low, abs(high - lag(close) OVER h), abs(low - lag(close) OVER h)) AS tr FROM hourly WINDOW h AS (PARTITION BY session, instrument ORDER BY hr))"


@query("scn_3_atr", "WITH " + _TR + f", p AS (SELECT *, list(tr) OVER (PARTITION BY session, instrument ORDER BY hr) AS v FROM t) SELECT session, instrument, hr, round({_ewm_sql('v', 1 / 14)}, 6) AS atr FROM p")
def atr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.atr(hourly(spark, sf), "high", "low", "close", KEYS, ["hr"]), "session", "instrument", "hr", "atr")


@query(
    "scn_4_macd",
    "WITH " + _PREFIX + f", m AS (SELECT *, {_ewm_sql('v', 2 / 13)} - {_ewm_sql('v', 2 / 27)} AS m FROM p), s AS (SELECT *, list(m) OVER {_W} AS ms FROM m) "
    + f"SELECT session, instrument, event_id, round(CASE WHEN rn >= 35 THEN m END, 6) AS macd, round(CASE WHEN rn >= 35 THEN {_ewm_sql('ms', 0.2)} END, 6) AS macd_signal FROM s",
)
def macd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.macd(bars(spark, sf), "price", KEYS, ORDER), *ID, "macd", "macd_signal")


@query(
    "scn_5_adx",
    "WITH " + _TR + """, d AS (SELECT *, high - lag(high) OVER h AS up, lag(low) OVER h - low AS down FROM t WINDOW h AS (PARTITION BY session, instrument ORDER BY hr)),
e AS (SELECT *, list(tr) OVER h AS vt, list(CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END) OVER h AS vp, list(CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END) OVER h AS vn FROM d WINDOW h AS (PARTITION BY session, instrument ORDER BY hr)),
f AS (SELECT session, instrument, hr, """ + ", ".join(f"{_ewm_sql(v, 1 / 14)} AS {n}" for v, n in (("vt", "st"), ("vp", "sp"), ("vn", "sn"))) + """ FROM e)
SELECT session, instrument, hr, round(100 * sp / nullif(st, 0), 6) AS plus_di, round(100 * sn / nullif(st, 0), 6) AS minus_di FROM f""",
)
def adx(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.adx(hourly(spark, sf), "high", "low", "close", KEYS, ["hr"]), "session", "instrument", "hr", "plus_di", "minus_di")


@query(
    "scn_6_bollinger",
    "WITH " + BARS + """, x AS (SELECT *, count(*) OVER v AS c, avg(price) OVER v AS m, stddev_pop(price) OVER v AS s FROM bars WINDOW v AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS 19 PRECEDING))
SELECT session, instrument, event_id, round(CASE WHEN c >= 20 THEN m + 2 * s END, 6) AS bb_upper, round(CASE WHEN c >= 20 THEN m - 2 * s END, 6) AS bb_lower, round(CASE WHEN c >= 20 THEN (price - m + 2 * s) / nullif(4 * s, 0) END, 6) AS bb_pct FROM x""",
)
def bollinger(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.bollinger(bars(spark, sf), "price", KEYS, ORDER), *ID, "bb_upper", "bb_lower", "bb_pct")


@query(
    "scn_7_cusum_whole_frame",
    "WITH RECURSIVE " + BARS + """, d AS (SELECT instrument, session, event_id, row_number() OVER w AS rn, coalesce(price - lag(price) OVER w, 0) AS d FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY session, ts, event_id)),
s AS (SELECT instrument, session, event_id, rn, 0.0::DOUBLE AS p, 0.0::DOUBLE AS n, 6 AS gp, 6 AS gn, 0 AS event FROM d WHERE rn = 1
  UNION ALL SELECT instrument, session, event_id, rn, CASE WHEN up OR down THEN 0 ELSE p END, CASE WHEN up OR down THEN 0 ELSE n END, CASE WHEN up AND gp > 5 THEN 0 ELSE gp END,
    CASE WHEN NOT up AND down AND gn > 5 THEN 0 ELSE gn END, CASE WHEN up THEN (gp > 5)::INT WHEN down THEN -(gn > 5)::INT ELSE 0 END
  FROM (SELECT d.instrument, d.session, d.event_id, d.rn, greatest(0, s.p + d.d) AS p, least(0, s.n + d.d) AS n, least(s.gp + 1, 6) AS gp, least(s.gn + 1, 6) AS gn, greatest(0, s.p + d.d) > 40 AS up, least(0, s.n + d.d) < -40 AS down
    FROM s JOIN d ON d.instrument = s.instrument AND d.rn = s.rn + 1))
SELECT instrument, session, event_id, event FROM s""",
)
def cusum_long(spark: SparkSession, sf: str) -> DataFrame:
    """Sums run on over all days of an instrument; a side that fires is quiet for five rows."""
    return C.cusum_long(bars(spark, sf).withColumn("limit", F.lit(40.0)), "price", "limit", ["instrument"], "session", ORDER, 5).select("instrument", "session", "event_id", "event")


@query(
    "scn_2_rsi_whole_frame",
    "WITH RECURSIVE " + BARS + """, d AS (SELECT instrument, session, event_id, row_number() OVER w AS rn, price - lag(price) OVER w AS d FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY session, ts, event_id)),
s AS (SELECT instrument, session, event_id, rn, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM d WHERE rn = 1
  UNION ALL SELECT d.instrument, d.session, d.event_id, d.rn, CASE WHEN s.g IS NULL THEN greatest(d.d, 0) ELSE s.g + (greatest(d.d, 0) - s.g) / 14 END, CASE WHEN s.l IS NULL THEN greatest(-d.d, 0) ELSE s.l + (greatest(-d.d, 0) - s.l) / 14 END
  FROM s JOIN d ON d.instrument = s.instrument AND d.rn = s.rn + 1)
SELECT instrument, session, event_id, round(CASE WHEN rn > 14 AND l > 0 THEN 100 - 100 / (1 + g / l) END, 6) AS rsi FROM s""",
)
def rsi_long(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.rsi_long(bars(spark, sf), "price", ["instrument"], "session", ORDER), "instrument", "session", "event_id", "rsi")


@query(
    "scn_7_cusum",
    "WITH RECURSIVE " + NUMBERED + f""", d AS (SELECT session, instrument, event_id, rn, coalesce(price - lag(price) OVER {_W}, 0) AS d FROM b),
s AS (SELECT session, instrument, event_id, rn, 0.0::DOUBLE AS p, 0.0::DOUBLE AS n, 0 AS event FROM d WHERE rn = 1
  UNION ALL SELECT d.session, d.instrument, d.event_id, d.rn,
    CASE WHEN greatest(0, s.p + d.d) > 15 OR least(0, s.n + d.d) < -15 THEN 0 ELSE greatest(0, s.p + d.d) END, CASE WHEN greatest(0, s.p + d.d) > 15 OR least(0, s.n + d.d) < -15 THEN 0 ELSE least(0, s.n + d.d) END,
    CASE WHEN greatest(0, s.p + d.d) > 15 THEN 1 WHEN least(0, s.n + d.d) < -15 THEN -1 ELSE 0 END FROM s JOIN d ON d.session = s.session AND d.instrument = s.instrument AND d.rn = s.rn + 1)
SELECT session, instrument, event_id, event FROM s""",
)
def cusum(spark: SparkSession, sf: str) -> DataFrame:
    return C.cusum(bars(spark, sf).withColumn("limit", F.lit(15.0)), "price", "limit", KEYS, ORDER).select(*ID, "event")


@query(
    "scn_11_non_overlapping",
    "WITH RECURSIVE " + NUMBERED + """, c AS (SELECT session, instrument, event_id, rn, epoch_us(ts)::DOUBLE AS s, epoch_us(ts) + volume * 60000000.0 AS e, price > 8 AS sig FROM b),
g AS (SELECT session, instrument, event_id, rn, sig AS accepted, CASE WHEN sig THEN e END AS until FROM c WHERE rn = 1
  UNION ALL SELECT c.session, c.instrument, c.event_id, c.rn, c.sig AND (g.until IS NULL OR c.s >= g.until), CASE WHEN c.sig AND (g.until IS NULL OR c.s >= g.until) THEN c.e ELSE g.until END FROM g JOIN c ON c.session = g.session AND c.instrument = g.instrument AND c.rn = g.rn + 1)
SELECT session, instrument, event_id, accepted FROM g""",
)
def non_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    b = bars(spark, sf).withColumn("s", start).withColumn("e", F.col("s") + F.col("volume").cast("long") * 60_000_000).withColumn("sig", F.col("price") > 8)
    return C.non_overlapping(b, KEYS, ORDER, "s", "e", "sig").select(*ID, "accepted")


@query(
    "scn_12_sequence_match",
    "WITH RECURSIVE " + NUMBERED + """, c AS (SELECT session, instrument, event_id, rn, price > 25 AS a, price < 5 AS z FROM b),
g AS (SELECT session, instrument, event_id, rn, CASE WHEN a THEN 1 ELSE -1 END AS at, false AS hit FROM c WHERE rn = 1
  UNION ALL SELECT c.session, c.instrument, c.event_id, c.rn, CASE WHEN c.z AND g.at > 0 AND c.rn - g.at <= 6 THEN CASE WHEN c.a THEN c.rn ELSE -1 END WHEN g.at > 0 AND c.rn - g.at <= 6 THEN g.at WHEN c.a THEN c.rn ELSE -1 END, c.z AND g.at > 0 AND c.rn - g.at <= 6
  FROM g JOIN c ON c.session = g.session AND c.instrument = g.instrument AND c.rn = g.rn + 1)
SELECT session, instrument, event_id, hit AS matched FROM g""",
)
def sequence_match(spark: SparkSession, sf: str) -> DataFrame:
    return C.sequence_match(bars(spark, sf), F.col("price") > 25, F.col("price") < 5, KEYS, ORDER, 6).select(*ID, "matched")


@query("agg_3_daily_bars", "WITH " + DAILY + " SELECT instrument, session, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, n FROM daily")
def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(daily(spark, sf))

