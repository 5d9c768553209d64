"""Forward-looking labels and exits (LBL family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .windows import over


def barrier_width(fixed: float, atr: str | None = None, factor: float = 1.0, low: float = 0.5, high: float = 2.0, price: str | None = None) -> Column:
    """LBL-2: a fixed return, or factor * atr / price within [low, high] times the fixed one."""
    if atr is None:
        return F.lit(fixed)
    return F.greatest(F.lit(fixed * low), F.least(F.lit(fixed * high), factor * F.col(atr) / F.col(price)))


def triple_barrier(df: DataFrame, keys: Sequence[str], minute: str, horizon: int, target: Column, stop: Column, open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> DataFrame:
    """LBL-1: long and short outcomes of entering at the open of the next minute's bar.

    The path is the bars of minutes m + 1 to m + horizon; entry and last minute must exist, else reason is
    invalid.  The first bar that touches a barrier decides; both in one bar is tp_sl_same_bar; none is
    time, at the last close.  minute: whole minutes of the session, one row each.
    """
    w = Window.partitionBy(*keys).orderBy(minute).rangeBetween(1, horizon)
    bar = F.struct(F.col(minute).alias("m"), F.col(open_).alias("o"), F.col(high).alias("h"), F.col(low).alias("l"), F.col(close).alias("c"))
    df = df.withColumn("_path", F.collect_list(bar).over(w)).withColumn("_t", target).withColumn("_s", stop)
    first, last = F.get("_path", F.lit(0)), F.try_element_at("_path", F.lit(-1))
    valid = (F.size("_path") > 0) & F.coalesce((first["m"] == F.col(minute) + 1) & (last["m"] == F.col(minute) + horizon), F.lit(False))
    df = df.withColumn("_ok", valid).withColumn("_e", F.when(valid, first["o"])).withColumn("_last", F.when(valid, last["c"]))
    out = df
    for side, sign in (("long", 1), ("short", -1)):
        tp, sl = F.col("_e") * (1 + sign * F.col("_t")), F.col("_e") * (1 - sign * F.col("_s"))
        out = _side(out, side, sign, tp, sl, minute)
    return out.drop("_path", "_t", "_s", "_ok", "_e", "_last")


def _side(df: DataFrame, side: str, sign: int, tp: Column, sl: Column, minute: str) -> DataFrame:
    won = (lambda b: b["h"] >= tp) if sign > 0 else (lambda b: b["l"] <= tp)
    lost = (lambda b: b["l"] <= sl) if sign > 0 else (lambda b: b["h"] >= sl)
    hit = F.get(F.filter("_path", lambda b: won(b) | lost(b)), F.lit(0))
    df = df.withColumn("_hit", F.when(F.col("_ok"), hit))
    h = F.col("_hit")
    reason = F.when(~F.col("_ok"), "invalid").when(h.isNull(), "time").when(won(h) & lost(h), "tp_sl_same_bar").when(won(h), "tp").otherwise("sl")
    df = df.withColumn(f"{side}_reason", reason)
    r = F.col(f"{side}_reason")
    exit_price = F.when(r == "time", F.col("_last")).when(r.isin("tp", "tp_sl_same_bar"), tp).when(r == "sl", sl)
    best = F.array_max(F.transform("_path", lambda b: b["h"])) if sign > 0 else F.array_min(F.transform("_path", lambda b: b["l"]))
    worst = F.array_min(F.transform("_path", lambda b: b["l"])) if sign > 0 else F.array_max(F.transform("_path", lambda b: b["h"]))
    ok = lambda c: F.when(F.col("_ok"), c)
    return df.withColumns(
        {
            f"{side}_return": ok(sign * (ratio(exit_price, "_e") - 1)), f"{side}_mfe": ok(sign * (ratio(best, "_e") - 1)), f"{side}_mae": ok(sign * (ratio(worst, "_e") - 1)),
            f"{side}_offset": ok(F.when(h.isNull(), F.try_element_at("_path", F.lit(-1))["m"]).otherwise(h["m"]) - F.col(minute)),
        }
    ).drop("_hit")


def best_side(long_return: str, short_return: str) -> Column:
    """LBL-3: CE for a better long, PE for a better short, null if neither is positive."""
    a, b = F.col(long_return), F.col(short_return)
    return F.when((a > 0) & (a >= F.coalesce(b, a)), "CE").when(b > 0, "PE")


def option_path(entries: DataFrame, quotes: DataFrame, recipes: DataFrame, keys: Sequence[str], minute: str = "minute") -> DataFrame:
    """LBL-4: an outcome or a skip reason for every (entry, recipe).

    entries: id, keys, minute, atm_strike, strike_step; recipes: recipe_id, side, steps, hold, stop_pct, target_pct;
    quotes: keys, minute, strike, side, close.  Closes of minutes 1 to hold after the entry are walked, a stop
    counts before a target; a missing quote on the way skips.  Reasons in order: no_atm, no_step, no_entry_quote,
    missing_path, else null.
    """
    both = entries.crossJoin(F.broadcast(recipes))  # a table of configuration
    strike = F.col("atm_strike") + F.when(F.col("side") == "CE", 1).otherwise(-1) * F.col("steps") * F.col("strike_step")
    both = both.withColumn("strike", strike).withColumn("_at", F.explode_outer(F.when(F.col("strike").isNotNull(), F.sequence(F.col(minute), F.col(minute) + F.col("hold")))))
    q = quotes.select(*keys, F.col(minute).alias("_at"), "strike", "side", F.col("close").alias("_c"))
    met = both.join(q, [*keys, "_at", "strike", "side"], "left")
    g = met.groupBy("id", "recipe_id").agg(
        *(F.first(c).alias(c) for c in (*keys, minute, "atm_strike", "strike_step", "side", "strike", "hold", "stop_pct", "target_pct")),
        F.max(F.when(F.col("_at") == F.col(minute), F.col("_c"))).alias("entry_premium"), F.array_sort(F.collect_list(F.when(F.col("_at") > F.col(minute), F.struct((F.col("_at") - F.col(minute)).alias("k"), F.col("_c").alias("c"))))).alias("_path"),
    )
    e = F.col("entry_premium")
    stopped, reached = lambda p: p["c"] <= e * (1 - F.col("stop_pct")), lambda p: p["c"] >= e * (1 + F.col("target_pct"))
    hit = F.get(F.filter("_path", lambda p: F.coalesce(stopped(p) | reached(p), F.lit(False))), F.lit(0))
    g = g.withColumn("_hit", hit)
    upto = F.when(F.col("_hit").isNotNull(), F.col("_hit.k")).otherwise(F.col("hold"))
    have = F.size(F.filter("_path", lambda p: (p["k"] <= upto) & p["c"].isNotNull()))
    skip = F.when(F.col("atm_strike").isNull(), "no_atm").when(F.col("strike_step").isNull(), "no_step").when(e.isNull() | (e <= 0), "no_entry_quote").when(have < upto, "missing_path")
    g = g.withColumn("reason_skipped", skip).withColumn("_end", F.coalesce(F.col("_hit"), F.try_element_at("_path", F.lit(-1))))
    ok = F.col("reason_skipped").isNull()
    why = F.when(F.col("_hit").isNull(), "max_hold").when(stopped(F.col("_hit")), "stop").otherwise("target")
    return g.select("id", "recipe_id", *keys, minute, "strike", "side", "entry_premium", F.when(ok, F.col("_end.c")).alias("exit_premium"), F.when(ok, F.col("_end.k")).alias("exit_offset"), F.when(ok, why).alias("exit_reason"), F.when(ok, F.col("_end.c") / e - 1).alias("pnl_pct"), "reason_skipped")


def forward_move(df: DataFrame, keys: Sequence[str], order: Sequence[str], price: str, high: str, low: str, h: int, points: float | None = None, pct: float | None = None, side: str = "any") -> DataFrame:
    """LBL-5: 1 if price moves by the threshold within the next h rows (up, down or any), null without a later row."""
    f = over(keys, order).rowsBetween(1, h)
    up, down = F.max(high).over(f) - F.col(price), F.col(price) - F.min(low).over(f)
    width = F.lit(points) if points is not None else F.col(price) * pct
    df = df.withColumn("move_up", up).withColumn("move_down", down)
    best = {"any": F.greatest("move_up", "move_down"), "up": F.col("move_up"), "down": F.col("move_down")}[side]
    return df.withColumn("move_label", F.when(best.isNotNull(), (best >= width).cast("int")))


def clean_start(df: DataFrame, keys: Sequence[str], order: Sequence[str], price: str, h: int, pct: float, n: int = 3, soft: bool = False) -> DataFrame:
    """LBL-6: 1 if the net move over h rows is at least pct and the first n changes go its way (soft: two thirds of them)."""
    w = over(keys, order)
    df = df.withColumn("_d", F.signum(F.lead(price, 1).over(w) - F.col(price))).withColumn("_net", ratio(F.lead(price, h).over(w), price) - 1)
    first = w.rowsBetween(0, n - 1)
    ups, downs = F.sum((F.col("_d") > 0).cast("int")).over(first), F.sum((F.col("_d") < 0).cast("int")).over(first)
    need = -(-2 * n // 3) if soft else n
    label = F.when(F.col("_net").isNull(), None).when((F.col("_net") >= pct) & (ups >= need), 1).when((F.col("_net") <= -pct) & (downs >= need), -1).otherwise(0)
    return df.withColumn("clean_move", label).drop("_d", "_net")


def clock_return(df: DataFrame, keys: Sequence[str], minute: str, price: str, at: int, ahead: int, threshold: float) -> DataFrame:
    """LBL-7: per session the return from one clock minute to another, label 1 / 0, ambiguous ones left out."""
    pick = lambda m: F.max(F.when(F.col(minute) == m, F.col(price)))
    g = df.groupBy(*keys).agg(pick(at).alias("p0"), pick(at + ahead).alias("p1")).withColumn("ret", ratio("p1", "p0") - 1)
    return g.where(F.abs("ret") >= threshold).withColumn("label", (F.col("ret") > 0).cast("int"))


def oracle(candidates: DataFrame, keys: Sequence[str], ret: str = "net_return", mae: str = "mae") -> DataFrame:
    """LBL-8, SRT-7: per row the best valid positive candidate: net return desc, adverse excursion asc, hold, stop, recipe asc."""
    ok = F.col(ret) > 0
    order = F.struct((-F.col(ret)).alias("a"), F.col(mae).alias("b"), F.col("hold").alias("c"), F.col("stop_pct").alias("d"), F.col("recipe_id").alias("e"), F.col("side").alias("f"))
    g = candidates.groupBy(*keys).agg(F.min_by(F.struct("recipe_id", "side", ret), F.when(ok, order)).alias("best"), F.max(ret).alias("best_return"))
    found = F.col("best_return") > 0
    return g.select(*keys, F.coalesce(found, F.lit(False)).cast("int").alias("entry_label"), F.when(found, F.col("best.side")).alias("direction_label"), F.when(found, F.col("best.recipe_id")).alias("recipe_label"), F.when(found, F.col(f"best.{ret}")).alias("best_return"))


def first_touch(paths: DataFrame, entry: str, price: str, step: str, stop: float | None = None, target: float | None = None, trail_arm: float | None = None, trail_back: float | None = None, time_stop: int | None = None, sign: int = 1) -> DataFrame:
    """LBL-12: exit of each trade: the first step at which stop, target, trailing give-back or time stop holds, in that
    order at one step, else the last step (end); pnl, running mfe and mae.  paths: id, step, entry and current price."""
    w = over(["id"], [step]).rowsBetween(Window.unboundedPreceding, 0)
    df = paths.withColumn("pnl", sign * (F.col(price) / F.col(entry) - 1))
    df = df.withColumn("mfe", F.max("pnl").over(w)).withColumn("mae", F.min("pnl").over(w))
    why = F.lit(None).cast("string")
    if time_stop is not None:
        why = F.when(F.col(step) >= time_stop, "time_stop").otherwise(why)
    if trail_arm is not None:
        why = F.when((F.col("mfe") >= trail_arm) & (F.col("mfe") - F.col("pnl") >= trail_back), "trail").otherwise(why)
    if target is not None:
        why = F.when(F.col("pnl") >= target, "target").otherwise(why)
    if stop is not None:
        why = F.when(F.col("pnl") <= -stop, "stop").otherwise(why)
    df = df.withColumn("why", why)
    row = F.struct(F.col(step).alias("step"), "pnl", "mfe", "mae", "why")
    g = df.groupBy("id").agg(F.min_by(row, F.when(F.col("why").isNotNull(), F.col(step))).alias("hit"), F.max_by(row, step).alias("end"))
    x = F.when(F.col("hit").isNotNull(), F.col("hit")).otherwise(F.col("end"))
    return g.withColumn("x", x).select("id", F.col("x.step").alias("exit_step"), F.coalesce("x.why", F.lit("end")).alias("exit_reason"), "x.pnl", "x.mfe", "x.mae")


def first_breach(keys: Sequence[str], ts: str, cond: Column) -> list[Column]:
    """LBL-14: aggregates: time of the first row where the condition holds and how many do."""
    return [F.min(F.when(cond, F.col(ts))).alias("first_breach"), F.count_if(cond).alias("breaches")]


def counterfactual(df: DataFrame, rule: Column, outcome: str, value_at_k: str) -> Column:
    """LBL-15: the value at bar k where the rule holds, else the outcome."""
    return F.when(F.coalesce(rule, F.lit(False)) & F.col(value_at_k).isNotNull(), F.col(value_at_k)).otherwise(F.col(outcome))


def move_class(up: str, down: str, small: float, big: float) -> Column:
    """LBL-16: NO_MOVE, CHOP (both sides), SMALL_ / BIG_ UP / DOWN from the largest excursions."""
    u, d = F.col(up), F.col(down)
    return F.when((u < small) & (d < small), "NO_MOVE").when((u >= small) & (d >= small), "CHOP").when(u >= big, "BIG_UP").when(d >= big, "BIG_DOWN").when(u >= small, "SMALL_UP").when(d >= small, "SMALL_DOWN")
