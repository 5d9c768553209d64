"""The feature set of a session at a cut-off (WIN-40): how fast things moved until then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import slope

#: What the features are made from: columns of the rows before the cut and of the row at it; one that isn't there is null.
INPUTS = ("open", "high", "low", "close", "vwap", "ce_oi", "pe_oi", "oi_ratio", "pcr", "pcr_change", "ce_volume", "pe_volume", "volume_total", "ce_iv", "pe_iv", "iv_skew", "break_up", "break_down")
#: What they also need of the row at the cut: the close of the day before, the volume at its cut, the mean of the 20 days before.
CONTEXT = ("prev_close", "prev_volume", "avg_volume")
#: A normalised slope below FLAT is no trend, a range below LEAST has no places, moves below STEP no direction, a gap counts beyond GAP.
FLAT, LEAST, STEP, GAP = 0.02, 10.0, 1.0, 0.003


def _sign(x: Column, dead: float) -> Column:
    return F.when(x > dead, 1.0).when(x < -dead, -1.0).otherwise(0.0)


def _adx(rows: Column, n: int = 14) -> Column:
    """The last ADX of rows with high, low and close, smoothed from the first row on."""
    start = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("h", "l", "c", "tr", "up", "down", "adx")), F.lit(1.0).alias("w"))
    mix = lambda y, x: F.when(y.isNull(), x).otherwise(y + (x - y) / n)

    def step(s: Column, r: Column) -> Column:
        rise, fall = r["high"] - s["h"], s["l"] - r["low"]
        up, down = F.when((rise > fall) & (rise > 0), rise).otherwise(0.0), F.when((fall > rise) & (fall > 0), fall).otherwise(0.0)
        ranges = F.array(F.abs(r["high"] - r["low"]), F.abs(r["high"] - s["c"]), F.abs(r["low"] - s["c"]))
        tr, plus, minus = mix(s["tr"], F.coalesce(F.array_max(ranges), F.lit(0.0))), mix(s["up"], up), mix(s["down"], down)
        a, b = 100 * F.try_divide(plus, tr), 100 * F.try_divide(minus, tr)
        dx = F.try_divide(100 * F.abs(a - b), a + b)
        w = s["w"] * (1 - 1 / n)  # a row without dx repeats the value and decays its weight
        adx = F.when(dx.isNull(), s["adx"]).when(s["adx"].isNull(), dx).otherwise((w * s["adx"] + dx / n) / (w + 1 / n))
        keep = F.when(dx.isNull() & s["adx"].isNotNull(), w).otherwise(F.lit(1.0))
        return F.struct(r["high"].alias("h"), r["low"].alias("l"), r["close"].alias("c"), tr.alias("tr"), plus.alias("up"), minus.alias("down"), adx.alias("adx"), keep.alias("w"))

    return F.aggregate(rows, start, step, lambda s: s["adx"])


def velocity_features(morning: DataFrame, at_cut: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], least: int = 3) -> DataFrame:
    """WIN-40: one row for each row of at_cut (one per keys): 41 features of the session's rows before the cut.

    morning: the rows of the window in time (its last may be the row at the cut), at_cut: the row at the cut, with CONTEXT.  Changes
    are against the first row and the 2nd, 3rd and 4th row before the last; values at the cut are those of its row, or of the
    last row where it has none.  Fewer than `least` rows, or no time: all null.
    """
    number = lambda d, c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) if c in d.columns else F.lit(None).cast("double")
    ordered = F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.col(ts).cast("timestamp").alias("at"), *(number(morning, c).alias(c) for c in INPUTS))
    rows = morning.groupBy(*keys).agg(F.array_sort(F.collect_list(ordered)).alias("v"))
    cut = at_cut.select(*keys, F.struct(F.col(ts).cast("timestamp").alias("at"), *(number(at_cut, c).alias(c) for c in (*INPUTS, *CONTEXT))).alias("m"))
    df = cut.join(rows, list(keys), "left")
    n = F.coalesce(F.size("v"), F.lit(0))
    nth = lambda i, c: F.get(F.col("v"), i)[c]
    first = lambda c: nth(F.lit(0), c)
    ago = lambda c, k: F.when(n > k, nth(F.greatest(n - 1 - k, F.lit(0)), c))
    mid = lambda c: F.coalesce(F.col("m")[c], ago(c, 0))
    since = lambda c: mid(c) - first(c)
    lately = lambda c: mid(c) - ago(c, 2)
    values = lambda c: F.transform("v", lambda r: r[c])
    minutes = F.greatest(F.lit(1.0), (F.unix_micros(F.col("m.at")) - F.unix_micros(first("at"))) / 60e6)

    def trend(c: str) -> Column:
        v = F.filter(values(c), lambda x: x.isNotNull())
        return F.when(F.get(v, F.lit(0)) == 0, slope(v, normal=False)).otherwise(slope(v))

    price, high, low, prev = mid("close"), F.array_max(values("high")), F.array_min(values("low")), F.col("m.prev_close")
    gap = first("open") - prev
    share = F.try_divide(gap, prev)
    filled = F.when(gap > 0, F.coalesce(price <= prev, F.lit(False))).when(gap < 0, F.coalesce(price >= prev, F.lit(False))).otherwise(F.lit(False))
    volume = F.coalesce(mid("volume_total"), mid("ce_volume") + mid("pe_volume"))
    before, after = ago("close", 2) - ago("close", 4), price - ago("close", 2)
    turned = (_sign(before, STEP) != 0) & (_sign(after, STEP) != 0) & (_sign(before, STEP) != _sign(after, STEP))
    ce, pe = since("ce_oi"), since("pe_oi")
    real = lambda c: c.cast("double")
    features = {
        "vel_ce_oi_delta_open": ce, "vel_pe_oi_delta_open": pe, "vel_ce_oi_delta_30m": lately("ce_oi"), "vel_pe_oi_delta_30m": lately("pe_oi"),
        "vel_oi_ratio_delta_open": since("oi_ratio"), "vel_oi_ratio_delta_30m": lately("oi_ratio"), "vel_ce_oi_build_rate": ce / minutes, "vel_pe_oi_build_rate": pe / minutes,
        "vel_pcr_delta_open": since("pcr"), "vel_pcr_delta_30m": lately("pcr"), "vel_pcr_acceleration": mid("pcr_change") - ago("pcr_change", 1), "vel_pcr_trend_direction": _sign(trend("pcr"), FLAT),
        "vel_price_delta_open": price - first("open"), "vel_price_delta_30m": lately("close"), "vel_price_delta_60m": price - ago("close", 4), "vel_price_acceleration": lately("close") - (ago("close", 2) - ago("close", 3)),
        "ctx_am_range_high": high, "ctx_am_range_low": low, "ctx_am_range_size": high - low,
        "ctx_am_price_position": F.when(high - low >= LEAST, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(price - low, high - low)))),
        "ctx_am_gap_from_yday": gap, "ctx_gap_pct": share, "ctx_gap_up": real(share > GAP), "ctx_gap_down": real(share < -GAP), "ctx_am_gap_filled": F.when(gap.isNotNull(), real(filled)),
        "vel_atm_ce_iv_delta_open": since("ce_iv"), "vel_atm_pe_iv_delta_open": since("pe_iv"), "vel_iv_skew_delta_open": since("iv_skew"), "vel_iv_compression_rate": since("ce_iv") / minutes,
        "vel_ce_vol_delta_30m": lately("ce_volume"), "vel_pe_vol_delta_30m": lately("pe_volume"), "vel_options_vol_acceleration": F.try_divide(lately("ce_volume"), F.abs(ago("ce_volume", 2) - ago("ce_volume", 3))),
        "ctx_am_vol_vs_yday": F.when(F.col("m.prev_volume") > 0, volume / F.col("m.prev_volume")), "vol_spike_ratio": F.when(F.col("m.avg_volume") > 0, volume / F.col("m.avg_volume")), "adx_14": _adx(F.col("v")),
        "ctx_am_trend": _sign(trend("close"), FLAT), "ctx_am_trend_strength": F.abs(trend("close")), "ctx_am_reversal": real(F.coalesce(turned, F.lit(False))),
        "ctx_am_oi_direction": F.when(ce.isNotNull() & pe.isNotNull(), F.when(ce > F.abs(pe) * 0.3, 1.0).when(pe > F.abs(ce) * 0.3, -1.0).otherwise(0.0)),
        "ctx_am_vwap_side": F.signum(price - mid("vwap")), "ctx_am_breakout_confirmed": real(F.coalesce((mid("break_up") == 1) | (mid("break_down") == 1), F.lit(False)) & mid("break_up").isNotNull() & mid("break_down").isNotNull()),
    }
    enough = (n >= least) & F.col("m.at").isNotNull() & first("at").isNotNull()
    return df.select(*keys, *(F.when(enough, c).alias(name) for name, c in features.items()))
