"""Training stages: which rows a stage keeps and why others go, and its labels (FLT, LBL, JOI and FUN rows on top of the basic ones).

Utilities are one row per key with the net return of the best long (ce) and best short (pe) candidate, a
0/1 entry label and a direction label.  A missing return counts as 0 and a missing entry label as 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ColumnOrName, col, result_label, safe_divide
from .select import top_fraction
from .windows import over, swing

# ---------------------------------------------------------------- filters


def is_filled(c: ColumnOrName) -> Column:
    """FLT-11: neither null nor empty."""
    return F.coalesce(col(c) != "", F.lit(False))


def blocks(cond: Column) -> Column:
    """FLT-10: a gate on a feature that may be missing: null blocks."""
    return F.coalesce(cond, F.lit(True))


def on_expiry(df: DataFrame, flag: str = "is_expiry_day", days: str = "dte") -> Column:
    """FLT-4: by the flag if there is such a column, else by no days left; null is no expiry day."""
    if flag in df.columns:
        return F.coalesce(F.col(flag).cast("double") == 1, F.lit(False))
    if days in df.columns:
        return F.coalesce(F.col(days).cast("double") == 0, F.lit(False))
    raise ValueError(f"neither {flag} nor {days} is a column")


def kept(df: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """FLT-4, FLT-8: the rows that pass all checks, and one row of counts: rows_before, rows_after and <check>_dropped,
    where a row counts for the first check it fails.  A null check fails."""
    reason = F.lit(None).cast("string")
    for name, check in reversed(checks.items()):
        reason = F.when(F.coalesce(check, F.lit(False)), reason).otherwise(F.lit(name))
    marked = df.withColumn("_reason", reason)
    dropped = [F.count_if(F.col("_reason") == n).alias(f"{n}_dropped") for n in checks]
    counts = marked.agg(F.count("*").alias("rows_before"), F.count_if(F.col("_reason").isNull()).alias("rows_after"), *dropped)
    return marked.where("_reason is null").drop("_reason"), counts


def without_expiry_days(df: DataFrame, context: DataFrame | None = None, keys: Sequence[str] = (), **names: str) -> tuple[DataFrame, DataFrame]:
    """FLT-4: rows off the expiry day, after the columns of context that df lacks were joined by its first row of each key."""
    if context is not None:
        more = [c for c in context.columns if c not in df.columns]
        if more:
            df = df.join(context.select(*keys, *more).dropDuplicates(list(keys)), list(keys), "left")
    return kept(df, {"expiry": ~on_expiry(df, **names)})


def _returns(direction: str = "direction_label") -> tuple[Column, Column, Column]:
    """Edge between the sides, the return of the labelled side and that of the other."""
    ce, pe = F.coalesce("ce", F.lit(0.0)), F.coalesce("pe", F.lit(0.0))
    up = F.upper(F.col(direction)) == "CE"
    return F.abs(ce - pe), F.when(up, ce).otherwise(pe), F.when(up, pe).otherwise(ce)


def label_filter(df: DataFrame, min_edge: float, positive_winner: bool = True, max_opposing: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """FLT-8: rows with edge and, if asked, a winner above 0 against an opposing side of at most max_opposing."""
    edge, winner, opposing = _returns()
    checks = {"edge": edge >= min_edge}
    if positive_winner:
        checks["winner"] = (winner > 0) & (opposing <= max_opposing)
    rows, counts = kept(df.withColumn("edge", edge), checks)
    return rows, counts


def decisive(df: DataFrame, min_edge: float, regime: str | None = None, allowed: Sequence[str] = ()) -> DataFrame:
    """FLT-9: rows whose sides differ by min_edge or more, of the allowed regimes if any are given."""
    df = df.where(_returns()[0] >= min_edge)
    return df.where(F.col(regime).isin(list(allowed))) if regime and allowed else df


# ---------------------------------------------------------------- labels


def with_move_labels(oracle: DataFrame, moves: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """LBL-9: the entry labels of an oracle replaced by those of moves (entry_label, entry_label_valid and other columns);
    its returns stay.  A row that moves doesn't have gets label 0 and validity 0."""
    out = oracle.drop(*columns).join(moves.select(*keys, *columns), list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("entry_label", "entry_label_valid") if c in columns})


def _entered() -> Column:
    return F.coalesce(F.col("entry_label"), F.lit(0)) == 1


def _sided(df: DataFrame, up: Column, move: Column | None = None) -> DataFrame:
    side = F.when(up, "CE").otherwise("PE")
    return df.withColumns({"direction_label": side, "move_label": F.lit(1) if move is None else move, "first_hit_side": F.when(up, "up").otherwise("down")})


def entry_stage(df: DataFrame, valid: str | None = None) -> DataFrame:
    """LBL-10: move_label_valid and move_label of every row: the entry label, times its validity where there is one."""
    ok = F.lit(1) if valid is None else F.coalesce(F.col(valid).cast("int"), F.lit(0))
    return df.withColumns({"move_label_valid": ok, "move_label": F.coalesce(F.col("entry_label"), F.lit(0)) * ok})


def direction_stage(df: DataFrame) -> DataFrame:
    """LBL-10: entered rows with a side."""
    side = F.upper(F.col("direction_label"))
    return _sided(df.where(_entered() & side.isin("CE", "PE")), side == "CE")


def market_direction_stage(df: DataFrame, min_edge: float, entered_only: bool = True, regime: str | None = None, allowed: Sequence[str] = ()) -> DataFrame:
    """LBL-10: the side with the better return, of rows with a decisive edge."""
    rows = decisive(df.where(_entered()) if entered_only else df, min_edge, regime, allowed)
    return _sided(rows, F.coalesce("ce", F.lit(0.0)) > F.coalesce("pe", F.lit(0.0)))


def side_win_stage(df: DataFrame, side: str, min_return: float) -> DataFrame:
    """LBL-10: whether one side (ce or pe) pays, CE for yes; returns nearer 0 than min_return are left out."""
    x = F.coalesce(side, F.lit(0.0))
    return _sided(df.where(F.abs(x) >= min_return), x > 0)


def recipe_stage(df: DataFrame) -> DataFrame:
    """LBL-10: entered rows with chosen_direction_up, 1 for CE."""
    return df.where(_entered()).withColumn("chosen_direction_up", F.coalesce((F.upper(F.col("direction_label")) == "CE").cast("int"), F.lit(0)))


def convicted(df: DataFrame, keys: Sequence[str], tie: Sequence[str], min_edge: float, min_winner: float, max_opposing: float, share: float, score: str = "edge_winner_min") -> tuple[DataFrame, DataFrame]:
    """LBL-11: rows that pass the thresholds, then of each group the best max(1, ceil(n * share)) by conviction: edge,
    winner_return or the lesser of both; and the counts of what the thresholds dropped."""
    edge, winner, opposing = _returns()
    df = df.withColumns({"edge": edge, "winner_return": winner, "_opposing": opposing})
    rows, counts = kept(df, {"edge": F.col("edge") >= min_edge, "winner": F.col("winner_return") >= min_winner, "opposing": F.col("_opposing") <= max_opposing})
    value = F.least("edge", "winner_return") if score == "edge_winner_min" else F.col(score)
    rows = rows.drop("_opposing").withColumn("conviction", value)
    return top_fraction(rows, keys, "conviction", tie, share), counts


def direction_or_no_trade_stage(df: DataFrame, keys: Sequence[str], tie: Sequence[str], **thresholds: object) -> DataFrame:
    """LBL-10, LBL-11: entered rows with a side; move_label is 1 for those that conviction keeps."""
    rows = df.where(_entered() & F.upper(F.col("direction_label")).isin("CE", "PE"))
    best, _ = convicted(rows, keys, tie, **thresholds)
    on = list(dict.fromkeys([*keys, *tie]))
    marked = rows.join(best.select(*on, F.lit(1).alias("_kept")), on, "left")
    return _sided(marked, F.upper(F.col("direction_label")) == "CE", F.coalesce("_kept", F.lit(0))).drop("_kept")


def swing_exit(df: DataFrame, keys: Sequence[str], order: Sequence[str], high: str, low: str, close: str, hold: int, lookback: int = 10, ahead: int = 30, sign: int = 1, default: float = 0.005) -> DataFrame:
    """LBL-13: entering at each row's close: the stop is the extreme of the last `lookback` rows and this one, the target
    the nearest extreme beyond the entry in the next `ahead` rows (default: so far from the entry if there is none).
    The first of the next `hold` rows that touches the stop, then the target, ends it; else their last close."""
    w = over(keys, order)
    top, bottom = swing(high, low, lookback, w)
    bar = F.struct(F.col(high).alias("h"), F.col(low).alias("l"), F.col(close).alias("c"))
    df = df.withColumns({"_entry": F.col(close), "_stop": bottom if sign > 0 else top, "_path": F.collect_list(bar).over(w.rowsBetween(1, max(hold, ahead)))})
    near = F.slice("_path", 1, ahead)
    if sign > 0:
        target = F.array_min(F.filter(F.transform(near, lambda b: b["h"]), lambda x: x > F.col("_entry")))
    else:
        target = F.array_max(F.filter(F.transform(near, lambda b: b["l"]), lambda x: x < F.col("_entry")))
    df = df.withColumn("_target", F.coalesce(target, F.col("_entry") * (1 + sign * default)))
    stopped = (lambda b: b["l"] <= F.col("_stop")) if sign > 0 else (lambda b: b["h"] >= F.col("_stop"))
    reached = (lambda b: b["h"] >= F.col("_target")) if sign > 0 else (lambda b: b["l"] <= F.col("_target"))
    df = df.withColumn("_held", F.slice("_path", 1, hold)).withColumn("_hit", F.get(F.filter("_held", lambda b: stopped(b) | reached(b)), F.lit(0)))
    why = F.when(F.col("_hit").isNull(), "session_end").when(stopped(F.col("_hit")), "stop_hit").otherwise("target_hit")
    df = df.withColumns({"swing_stop": F.col("_stop"), "swing_target": F.col("_target"), "exit_reason": why})
    price = F.when(F.col("exit_reason") == "stop_hit", F.col("_stop")).when(F.col("exit_reason") == "target_hit", F.col("_target")).otherwise(F.coalesce(F.try_element_at("_held", F.lit(-1))["c"], F.col("_entry")))
    df = df.withColumn("swing_exit", price).withColumn("swing_pnl", sign * 100 * safe_divide(F.col("swing_exit") - F.col("_entry"), "_entry"))
    return df.drop("_entry", "_stop", "_target", "_path", "_held", "_hit")


# ---------------------------------------------------------------- blocks of daily context and enriched trades


def volatility_block(daily: DataFrame, keys: Sequence[str], day: str, open_: str, close: str, live: str | None = None, session_open: str | None = None, low: float = 14.0, high: float = 20.0, spike: float = 15.0) -> DataFrame:
    """FUN-24: of a daily index: the close of the last day before, open (else that close, else the session's first tick),
    current (the live tick, else the close, else the open), changes in percent, regime and a spike flag."""
    pick = lambda c: F.col(c) if c else F.lit(None).cast("double")
    df = daily.withColumn("vix_prev_close", F.lag(close).over(over(keys, [day])))
    df = df.withColumn("vix_open", F.coalesce(F.col(open_), "vix_prev_close", pick(session_open)))
    df = df.withColumn("vix_current", F.coalesce(pick(live), F.col(close), "vix_open"))
    change = lambda base: 100 * safe_divide(F.col("vix_current") - F.col(base), base)
    df = df.withColumns({"vix_change_from_prev": change("vix_prev_close"), "vix_intraday_chg": change("vix_open")})
    c = F.col("vix_current")
    return df.withColumns({"vix_regime": F.when(c < low, "LOW").when(c <= high, "NORMAL").when(c > high, "ELEVATED"), "vix_spike_flag": F.coalesce(F.col("vix_intraday_chg") > spike, F.lit(False))})


def enriched_trades(trades: DataFrame, signals: DataFrame, votes: DataFrame, pnl: str = "ret", reason: str = "exit_reason", stops: Sequence[str] = ("STOP_LOSS", "TRAILING_STOP", "RISK_BREACH"), times: Sequence[str] = ("TIME_STOP",)) -> DataFrame:
    """JOI-19: trades(signal_id, snapshot_id, regime, ...) with their signal's confidence and regime (the signal's counts
    first), the votes of their snapshot, a result and an outcome class.

    signals has one row per signal_id; votes(snapshot_id, vote) are counted first, so a trade stays one row.
    """
    per = votes.groupBy("snapshot_id").agg(F.count("*").alias("votes"), F.count_if(F.col("vote") == "CE").alias("ce_votes"), F.count_if(F.col("vote") == "PE").alias("pe_votes"))
    s = signals.select("signal_id", F.col("regime").alias("_regime"), F.col("confidence").alias("signal_confidence"))
    out = trades.join(s, "signal_id", "left").join(per, "snapshot_id", "left")
    why = F.upper(F.trim(F.col(reason)))
    outcome = F.when(why.isin(list(stops)), "stop").when(why.isin(list(times)), "time").when(F.col(pnl) > 0, "win").when(F.col(pnl) < 0, "loss").otherwise("unknown")
    own = F.nullif(F.trim(F.col("_regime")), F.lit(""))
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("votes", "ce_votes", "pe_votes")}
    return out.withColumns({"regime": F.coalesce(own, "regime"), "result": F.coalesce(result_label(pnl), F.lit("UNKNOWN")), "actual_outcome": outcome, **counts}).drop("_regime")
