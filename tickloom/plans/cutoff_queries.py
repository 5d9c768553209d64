"""Features at a cut-off, seeded ranges and completeness with history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import scans as C
from ..operators import windows as W
from ..operators.velocity import velocity_features
from .catalogue import query, rounded
from .views import HOURLY, KEYS, hourly

#: Stand-ins: volume and ticks of an hour for open interest of both sides, the price's place and gains for ratios.
_COLUMNS = {
    "open": "open", "high": "high", "low": "low", "close": "close", "vwap": "(high + low + close) / 3", "ce_oi": "CAST(volume AS DOUBLE)", "pe_oi": "CAST(n * 10 AS DOUBLE)", "oi_ratio": "n / nullif(volume, 0)", "pcr": "close / nullif(open, 0)",
    "pcr_change": "close - open", "ce_volume": "CAST(volume * n AS DOUBLE)", "pe_volume": "CAST(n * n AS DOUBLE)", "ce_iv": "high / 100", "pe_iv": "CASE WHEN n > 2 THEN low / 100 END", "iv_skew": "(high - low) / 100",
    "break_up": "CASE WHEN close > open THEN 1 ELSE 0 END", "break_down": "CASE WHEN close < low + 1 THEN 1 ELSE 0 END",
}


def _slope(v: str) -> str:
    """Least squares over 0 .. n - 1, over the first value (1 if that is 0)."""
    raw = f"(list_sum(list_transform(range(len({v})), lambda i: i * {v}[i + 1])) - (len({v}) - 1) / 2 * list_sum({v})) / (len({v}) * (len({v}) * len({v}) - 1) / 12)"
    return f"CASE WHEN len({v}) >= 2 THEN {raw} / CASE WHEN {v}[1] = 0 THEN 1 ELSE abs({v}[1]) END END"


def _sign(x: str, dead: float) -> str:
    return f"(CASE WHEN {x} > {dead} THEN 1.0 WHEN {x} < -{dead} THEN -1.0 ELSE 0.0 END)"


def _ago(c: str, k: int) -> str:
    return f"CASE WHEN n > {k} THEN v[n - {k}].{c} END"


def _mid(c: str) -> str:
    return f"coalesce(m.{c}, v[n].{c})"


_SINCE = {f"vel_{n}_delta_open": f"{_mid(c)} - v[1].{c}" for n, c in (("ce_oi", "ce_oi"), ("pe_oi", "pe_oi"), ("oi_ratio", "oi_ratio"), ("pcr", "pcr"), ("atm_ce_iv", "ce_iv"), ("atm_pe_iv", "pe_iv"), ("iv_skew", "iv_skew"))}
_LATELY = {f"vel_{n}_delta_30m": f"{_mid(c)} - ({_ago(c, 2)})" for n, c in (("ce_oi", "ce_oi"), ("pe_oi", "pe_oi"), ("oi_ratio", "oi_ratio"), ("pcr", "pcr"), ("price", "close"), ("ce_vol", "ce_volume"), ("pe_vol", "pe_volume"))}
_HIGH, _LOW, _GAP = "list_max(list_transform(v, lambda r: r.high))", "list_min(list_transform(v, lambda r: r.low))", "(v[1].open - prev_close)"
_BEFORE, _AFTER, _VOL = f"(({_ago('close', 2)}) - ({_ago('close', 4)}))", f"({_mid('close')} - ({_ago('close', 2)}))", f"({_mid('ce_volume')} + {_mid('pe_volume')})"
_MINUTES, _CE, _PE, _CLOSES = "greatest(1.0, (m.hr - v[1].hr) * 60)", f"({_mid('ce_oi')} - v[1].ce_oi)", f"({_mid('pe_oi')} - v[1].pe_oi)", "list_transform(v, lambda r: r.close)"
_FEATURES = _SINCE | _LATELY | {
    "vel_ce_oi_build_rate": f"{_CE} / {_MINUTES}", "vel_pe_oi_build_rate": f"{_PE} / {_MINUTES}", "vel_pcr_acceleration": f"{_mid('pcr_change')} - ({_ago('pcr_change', 1)})",
    "vel_pcr_trend_direction": _sign(_slope("list_transform(v, lambda r: r.pcr)"), 0.02), "vel_price_delta_open": f"{_mid('close')} - v[1].open", "vel_price_delta_60m": f"{_mid('close')} - ({_ago('close', 4)})",
    "vel_price_acceleration": f"{_AFTER} - (({_ago('close', 2)}) - ({_ago('close', 3)}))", "ctx_am_range_high": _HIGH, "ctx_am_range_low": _LOW, "ctx_am_range_size": f"{_HIGH} - {_LOW}",
    "ctx_am_price_position": f"CASE WHEN {_HIGH} - {_LOW} >= 10 THEN greatest(0.0, least(1.0, ({_mid('close')} - {_LOW}) / ({_HIGH} - {_LOW}))) END", "ctx_am_gap_from_yday": _GAP, "ctx_gap_pct": f"{_GAP} / prev_close",
    "ctx_gap_up": f"({_GAP} / prev_close > 0.003)::INT::DOUBLE", "ctx_gap_down": f"({_GAP} / prev_close < -0.003)::INT::DOUBLE",
    "ctx_am_gap_filled": f"CASE WHEN {_GAP} > 0 THEN ({_mid('close')} <= prev_close)::INT WHEN {_GAP} < 0 THEN ({_mid('close')} >= prev_close)::INT WHEN {_GAP} = 0 THEN 0 END::DOUBLE",
    "vel_iv_compression_rate": f"({_mid('ce_iv')} - v[1].ce_iv) / {_MINUTES}",
    "vel_options_vol_acceleration": f"({_mid('ce_volume')} - ({_ago('ce_volume', 2)})) / nullif(abs(({_ago('ce_volume', 2)}) - ({_ago('ce_volume', 3)})), 0)",
    "ctx_am_vol_vs_yday": f"{_VOL} / prev_volume", "vol_spike_ratio": f"{_VOL} / avg_volume", "ctx_am_trend": _sign(_slope(_CLOSES), 0.02), "ctx_am_trend_strength": f"abs({_slope(_CLOSES)})",
    "ctx_am_reversal": f"CASE WHEN {_sign(_BEFORE, 1)} <> 0 AND {_sign(_AFTER, 1)} <> 0 AND {_sign(_BEFORE, 1)} <> {_sign(_AFTER, 1)} THEN 1.0 ELSE 0.0 END",
    "ctx_am_oi_direction": f"CASE WHEN {_CE} > abs({_PE}) * 0.3 THEN 1.0 WHEN {_PE} > abs({_CE}) * 0.3 THEN -1.0 WHEN {_CE} IS NOT NULL AND {_PE} IS NOT NULL THEN 0.0 END",
    "ctx_am_vwap_side": f"sign({_mid('close')} - {_mid('vwap')})::DOUBLE", "ctx_am_breakout_confirmed": f"({_mid('break_up')} = 1 OR {_mid('break_down')} = 1)::INT::DOUBLE",
}


@query(
    "win_40_velocity_features",
    "WITH " + HOURLY + ", c AS (SELECT session, instrument, hr, " + ", ".join(f"{x} AS {c}" for c, x in _COLUMNS.items()) + """ FROM hourly),
am AS (SELECT session, instrument, list(c ORDER BY hr) AS v, count(*) AS n FROM c WHERE hr BETWEEN 4 AND 11 GROUP BY ALL),
last AS (SELECT session, instrument, last(close ORDER BY hr) AS close FROM hourly GROUP BY ALL),
prev AS (SELECT session, instrument, lag(close) OVER (PARTITION BY instrument ORDER BY session) AS prev_close FROM last),
cut AS (SELECT *, lag(vol) OVER w AS prev_volume, avg(vol) OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS avg_volume FROM (SELECT session, instrument, c AS m, ce_volume + pe_volume AS vol FROM c WHERE hr = 11) WINDOW w AS (PARTITION BY instrument ORDER BY session))
SELECT session, instrument, """ + ", ".join(f"round(CASE WHEN n >= 3 THEN {x} END, 6) AS {c}" for c, x in _FEATURES.items()) + " FROM cut LEFT JOIN am USING (session, instrument) LEFT JOIN prev USING (session, instrument)",
)
def velocity(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of an hour from 4 to 11 stand for the morning, that of 11 for the row at the cut; all features but ADX, which has a test."""
    h = hourly(spark, sf)
    c = h.select(*KEYS, "hr", (F.col("session").cast("timestamp") + F.make_dt_interval(hours=F.col("hr"))).alias("at"), *(F.expr(x).alias(n) for n, x in _COLUMNS.items()))
    days = Window.partitionBy("instrument").orderBy("session")
    last = h.groupBy(*KEYS).agg(F.max_by("close", "hr").alias("close"))
    prev = last.select(*KEYS, F.lag("close").over(days).alias("prev_close"))
    volume = F.col("ce_volume") + F.col("pe_volume")
    mean, before = W.trailing_sessions("_v", ["instrument"], "session", 20)
    cut = c.where("hr = 11").withColumn("_v", volume).withColumns({"prev_volume": before, "avg_volume": mean}).join(prev, KEYS, "left")
    return rounded(velocity_features(c.where("hr between 4 and 11"), cut, KEYS, "at", ["hr"]).drop("adx_14"))


@query(
    "scn_3_atr_seeded",
    "WITH " + HOURLY + """, t AS (SELECT session, instrument, hr, row_number() OVER w AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM hourly WINDOW w AS (PARTITION BY session, instrument ORDER BY hr)),
p AS (SELECT *, list(tr) FILTER (rn > 1) OVER (PARTITION BY session, instrument ORDER BY hr) AS v FROM t)
SELECT session, instrument, hr, round(CASE WHEN rn > 5 THEN list_reduce(list_concat([list_sum(v[1:5]) / 5], v[6:]), lambda y, x: y + (x - y) / 5) END, 6) AS atr FROM p""",
)
def seeded_atr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.atr(hourly(spark, sf), "high", "low", "close", KEYS, ["hr"], n=5, seeded=True), *KEYS, "hr", "atr")


@query(
    "dqc_5_completeness_with_history",
    "WITH " + HOURLY + """, d AS (SELECT session, row_number() OVER (ORDER BY session) AS number FROM (SELECT DISTINCT session FROM hourly)),
x AS (SELECT *, row_number() OVER w AS rn, floor(close / 20) AS strike, lag(floor(close / 20)) OVER w AS before, CASE WHEN volume > 60 THEN volume END AS vol, lag(close, 3) OVER w AS back FROM hourly JOIN d USING (session) WINDOW w AS (PARTITION BY session, instrument ORDER BY hr)),
e AS (SELECT session, instrument, 'vol' AS c, vol IS NOT NULL AS f, 0.9 AS least FROM x WHERE number >= 6 AND strike = before AND n > 0 UNION ALL SELECT session, instrument, 'back', back IS NOT NULL, 0.98 FROM x WHERE rn > 3)
SELECT session, instrument, c AS "column", count(*) AS eligible, round(avg(f::INT), 6) AS filled, avg(f::INT) >= any_value(least) AS ok FROM e GROUP BY ALL""",
)
def history_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """A column that needs five days of history and the strike of the hour before, and one that needs three rows."""
    w = W.over(KEYS, ["hr"])
    h = hourly(spark, sf).withColumns({"strike": F.floor(F.col("close") / 20), "vol": F.when(F.col("volume") > 60, F.col("volume")), "back": F.lag("close", 3).over(w)})
    same = Q.same_strike("strike", "ticks", KEYS, ["hr"])
    h = h.withColumnRenamed("n", "ticks").withColumn("same", same)
    return rounded(Q.completeness(h, KEYS, ["hr"], {"vol": 0, "back": 3}, day="session", sessions={"vol": 6}, continuity={"vol": F.col("same")}, thresholds={"vol": 0.9}))
