"""Cross-section operators over chains of strikes (CHN family).

Long form: keys (instrument, ts), strike, side (CE, PE), ltp, oi, volume; one row per key, strike and side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_divide
from .select import nearest_value
from .windows import over, running


def aggregate_minute(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """AGG-2: one row per key, strike and side: last price, first open, sums of oi and volume, extremes."""
    o = F.struct(*order)
    return df.groupBy(*keys, "strike", "side").agg(F.max_by("ltp", o).alias("ltp"), F.min_by("ltp", o).alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.sum("oi").alias("oi"), F.sum("volume").alias("volume"))


def pivoted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CHN-1: ce_ and pe_ columns per strike; missing oi and volume are 0, prices null."""
    side = lambda s, v: F.max(F.when(F.col("side") == s, F.col(v)))
    cols = {f"{s.lower()}_{v}": (F.coalesce(side(s, v), F.lit(0.0)) if v != "ltp" else side(s, v)) for s in ("CE", "PE") for v in ("ltp", "oi", "volume")}
    return df.groupBy(*keys, "strike").agg(*(c.alias(n) for n, c in cols.items()))


def totals(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CHN-2: sums per side, put-call ratio (null without call oi), number of strikes."""
    g = wide.groupBy(*keys).agg(F.sum("ce_oi").alias("ce_oi"), F.sum("pe_oi").alias("pe_oi"), F.sum("ce_volume").alias("ce_volume"), F.sum("pe_volume").alias("pe_volume"), F.count("*").alias("strikes"))
    return g.withColumn("pcr", safe_divide("pe_oi", "ce_oi"))


def max_pain(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CHN-3: the strike of the least total payout, the lowest of equals; prefix sums from both ends, no pairs of strikes."""
    w = running(over(keys, ["strike"]))
    whole = Window.partitionBy(*keys)
    k = F.col("strike").cast("double")
    below, below_k = F.sum("ce_oi").over(w), F.sum(k * F.col("ce_oi")).over(w)
    above, above_k = F.sum("pe_oi").over(whole) - F.sum("pe_oi").over(w), F.sum(k * F.col("pe_oi")).over(whole) - F.sum(k * F.col("pe_oi")).over(w)
    pain = wide.withColumn("pain", F.round(k * below - below_k + above_k - k * above, 6))
    return pain.groupBy(*keys).agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("pain"))


def at_the_money(wide: DataFrame, keys: Sequence[str], spot: DataFrame, price: str) -> DataFrame:
    """CHN-4: nearest strike to the spot of the key, straddle price and its share of the spot."""
    met = wide.join(spot, list(keys))
    best = met.groupBy(*keys).agg(nearest_value("strike", price).alias("atm_strike"), F.first(price).alias(price))
    rows = wide.select(*keys, F.col("strike").alias("atm_strike"), (F.col("ce_ltp") + F.col("pe_ltp")).alias("straddle"))
    return best.join(rows, [*keys, "atm_strike"]).withColumn("straddle_pct", safe_divide("straddle", price))


def ladder(wide: DataFrame, keys: Sequence[str], atm: DataFrame, near: int = 1, far: int = 3) -> DataFrame:
    """CHN-5: sums within +-near and +-far strikes by rank around the atm_strike of atm: put-call ratios, oi and volume shares."""
    ranked = wide.withColumn("r", F.row_number().over(over(keys, ["strike"]))).join(atm.select(*keys, "atm_strike"), list(keys))
    d = F.abs(F.col("r") - F.max(F.when(F.col("strike") == F.col("atm_strike"), F.col("r"))).over(Window.partitionBy(*keys)))
    ranked = ranked.withColumn("d", d)
    within = lambda n, c: F.sum(F.when(F.col("d") <= n, F.col(c)).otherwise(0.0))
    oi, vol = F.col("ce_oi") + F.col("pe_oi"), F.col("ce_volume") + F.col("pe_volume")
    g = ranked.withColumn("oi", oi).withColumn("vol", vol).groupBy(*keys)
    out = g.agg(*(within(n, c).alias(f"{c}_{n}") for n in (near, far) for c in ("ce_oi", "pe_oi", "oi", "vol")), F.sum("oi").alias("oi_all"), F.sum("vol").alias("vol_all"))
    for n in (near, far):
        out = out.withColumn(f"pcr_{n}", safe_divide(f"pe_oi_{n}", f"ce_oi_{n}")).withColumn(f"oi_share_{n}", safe_divide(f"oi_{n}", "oi_all")).withColumn(f"vol_share_{n}", safe_divide(f"vol_{n}", "vol_all"))
    return out.select(*keys, *(f"{c}_{n}" for n in (near, far) for c in ("pcr", "oi_share", "vol_share")))


def top_oi(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CHN-6: strike of the largest oi per side, the lowest of equals."""
    best = lambda c: F.max_by("strike", F.struct(F.col(c), -F.col("strike")))
    return wide.groupBy(*keys).agg(best("ce_oi").alias("ce_top_strike"), best("pe_oi").alias("pe_top_strike"))


def microstructure(wide: DataFrame, keys: Sequence[str], atm: DataFrame, step: int = 1) -> DataFrame:
    """CHN-7: features around the atm_strike by strike value: oi ratio, concentration, skew, distances, premium ratio and range."""
    m = wide.join(atm.select(*keys, "atm_strike"), list(keys)).withColumn("z", F.col("strike") - F.col("atm_strike")).withColumn("oi", F.col("ce_oi") + F.col("pe_oi")).withColumn("vol", F.col("ce_volume") + F.col("pe_volume"))
    s = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    z = F.col("z")
    at, near = z == 0, F.abs(z) <= 5 * step
    low4, high4 = (z < 0) & (z >= -4 * step), (z > 0) & (z <= 4 * step)
    g = m.groupBy(*keys).agg(
        F.max("atm_strike").alias("atm_strike"), s(at, "pe_oi").alias("a"), s(at, "ce_oi").alias("b"), s(near, "oi").alias("c"), F.sum("oi").alias("d"), F.max_by("strike", F.struct(F.col("oi"), -F.col("strike"))).alias("top"), s(low4, "pe_oi").alias("e"), s(high4, "ce_oi").alias("f"),
        s(at, "ce_volume").alias("g"), s(at, "pe_volume").alias("h"), s(F.abs(z) > 5 * step, "vol").alias("i"), s(near, "vol").alias("j"), F.sum(F.abs(z) * F.col("vol")).alias("k"), F.sum("vol").alias("l"),
        F.max(F.when(at, F.col("ce_ltp"))).alias("m"), F.max(F.when(at, F.col("pe_ltp"))).alias("n"), F.max(F.greatest("ce_ltp", "pe_ltp")).alias("o"), F.min(F.least("ce_ltp", "pe_ltp")).alias("p"), s(z >= 5 * step, "ce_oi").alias("q"), s(z <= -5 * step, "pe_oi").alias("r"),
    )
    f = safe_divide
    cols = {
        "atm_oi_ratio": f("a", "b"), "oi_concentration": f("c", "d"), "top_oi_distance": (F.col("top") - F.col("atm_strike")).cast("double"), "oi_skew": f(F.col("e") - F.col("f"), F.col("e") + F.col("f")), "atm_volume_ratio": f("g", "h"),
        "otm_volume_ratio": f("i", "j"), "volume_distance": f("k", "l"), "premium_ratio": f("m", "n"), "premium_range": F.col("o") - F.col("p"), "wing_ratio": f("q", "r"),
    }
    return g.select(*keys, "atm_strike", *(c.alias(n) for n, c in cols.items()))


def strike_step(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """CHN-8: least gap between neighbouring strikes."""
    s = df.select(*keys, "strike").distinct()
    return s.withColumn("gap", F.col("strike") - F.lag("strike").over(over(keys, ["strike"]))).groupBy(*keys).agg(F.min("gap").alias("strike_step"))


def otm_strike(atm, side, steps: int, step: float):
    """CHN-9: n steps out of the money: above for calls, below for puts."""
    return atm + F.when(side == "CE", F.lit(1)).otherwise(F.lit(-1)) * steps * step


def held_paths(entries: DataFrame, chain: DataFrame, key: Sequence[str], ts: str, horizon: int, price: str = "ltp", columns: Sequence[str] = ()) -> DataFrame:
    """CHN-10: for each entry (id, key columns, entry_ts) a row at each time step of (entry, entry + horizon] with the price of
    the entry's contract, carried forward while it is absent.  ts and entry_ts are whole numbers."""
    steps = entries.withColumn(ts, F.explode(F.sequence(F.col("entry_ts") + 1, F.col("entry_ts") + horizon)))
    met = steps.join(chain.select(*key, ts, F.col(price).alias("_p"), *columns), [*key, ts], "left")
    return met.withColumn("path_price", F.last("_p", ignorenulls=True).over(running(over(["id"], [ts])))).drop("_p")


def atm_iv(ce, pe):
    """CHN-11: mean of the sides there are, and the skew (put minus call)."""
    return F.struct(F.coalesce((ce + pe) / 2, ce, pe).alias("iv"), (pe - ce).alias("skew"))
