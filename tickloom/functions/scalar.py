"""Scalar functions on strings, dates, numbers, books of levels and option contracts (FUN, PRJ, FLT families)."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- names and types


def normal_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """PRJ-1: strip, lower, spaces to underscores."""
    return df.toDF(*map(normal_name, df.columns))


def rename_synonyms(df: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """PRJ-2: the first synonym that is present gets the name, unless the name itself is present."""
    names = {}
    for target, others in synonyms.items():
        if target not in df.columns and (found := next((o for o in others if o in df.columns), None)):
            names[found] = target
    return df.withColumnsRenamed(names)


def first_present(df: DataFrame, *names: str, default: ColumnOrName | None = None) -> Column:
    """PRJ-10: the first of the names that is a column; presence of the column, not of its value."""
    found = next((F.col(n) for n in names if n in df.columns), None)
    return found if found is not None else (F.lit(None).cast("double") if default is None else col(default))


def ensure_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """PRJ-6: add the missing columns as nulls of their type."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})


def canonical_bars(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """PRJ-6: OHLCV columns present and numeric, rows without a timestamp dropped."""
    numbers = ("open", "high", "low", "close", "volume", "oi")
    df = ensure_columns(df, dict.fromkeys(numbers, "double"))
    return df.withColumns({c: number(c) for c in numbers}).dropna(subset=[ts])


def number(c: ColumnOrName) -> Column:
    """PRJ-5: numeric or null; NaN is null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def resolve_timestamp(df: DataFrame, timestamp: str = "timestamp", date: Sequence[str] = ("trade_date", "date"), time: str = "time") -> Column:
    """PRJ-3: timestamp, else date and time, else date; null on failure."""
    found = []
    if timestamp in df.columns:
        found.append(F.try_to_timestamp(F.col(timestamp).cast("string")))
    day = next((d for d in date if d in df.columns), None)
    if day and time in df.columns:
        found.append(F.try_to_timestamp(F.concat_ws(" ", F.col(day).cast("string"), F.col(time).cast("string"))))
    if day:
        found.append(F.try_to_timestamp(F.col(day).cast("string")))
    return F.coalesce(*found) if found else F.lit(None).cast("timestamp")


def parse_date(c: ColumnOrName, formats: Sequence[str] = ("dd-MMM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd")) -> Column:
    """PRJ-4: the first format that fits, row by row (a whole-column fallback isn't a per-row rule)."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(col(c), F.lit(f))) for f in formats))


def filled_text(c: ColumnOrName, default: str) -> Column:
    """PRJ-11: blank, nan and None are the default."""
    x = F.trim(col(c).cast("string"))
    return F.when(x.isNull() | x.isin("", "nan", "None"), F.lit(default)).otherwise(x)


def with_lineage(df: DataFrame, **constants: str) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def select_by_pattern(df: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """PRJ-12: columns that a pattern includes and none excludes."""
    return [c for c in df.columns if any(re.fullmatch(p, c) for p in include) and not any(re.fullmatch(p, c) for p in exclude)]


def numeric_features(df: DataFrame, identity: Sequence[str], leak_prefixes: Sequence[str] = ("label", "y_", "future_")) -> list[str]:
    """PRJ-13: numeric columns but for identity, labels and what leaks them."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in identity and not c.startswith(tuple(leak_prefixes))]


# ---------------------------------------------------------------- numbers


def safe_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """FUN-9: null where the divisor is 0 or null."""
    return F.when(col(b) != 0, col(a) / col(b))


def ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """FUN-9: a / b as floats have it: infinite for a divisor of 0, NaN for 0 / 0, null only where one is null."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b != 0, a / b).when(b == 0, F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan")))


def clip(x: ColumnOrName, low: float, high: float) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))


def dead_sign(x: ColumnOrName, zone: float = 0.0) -> Column:
    """FUN-9: -1, 0 or 1; 0 within the zone."""
    x = col(x)
    return F.when(x > zone, 1).when(x < -zone, -1).when(x.isNotNull(), 0)


def round_to_step(x: ColumnOrName, step: float) -> Column:
    """FUN-9: nearest multiple, halves to even."""
    return F.bround(col(x) / step, 0) * step


def minute_of_day(ts: ColumnOrName) -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def session_phase(ts: ColumnOrName, bounds: Sequence[tuple[str, int, int]]) -> Column:
    """FUN-5, FLT-5: the name of the half-open minute range that holds the time, else null."""
    m, out = minute_of_day(ts), F.lit(None).cast("string")
    for name, a, b in reversed(bounds):
        out = F.when((m >= a) & (m < b), F.lit(name)).otherwise(out)
    return out


def minutes_since(ts: ColumnOrName, start: int) -> Column:
    """FUN-5: null before the start."""
    m = minute_of_day(ts)
    return F.when(m >= start, m - start)


def minutes_to(ts: ColumnOrName, end: int) -> Column:
    return F.greatest(F.lit(0), F.lit(end) - minute_of_day(ts))


def monday_zero(ts: ColumnOrName) -> Column:
    return F.weekday(col(ts))


def bar_floor(ts: ColumnOrName, minutes: int) -> Column:
    """Start of the k-minute bar that holds the time, aligned to the clock."""
    t = col(ts)
    return (F.date_trunc("DAY", t) + F.make_dt_interval(mins=(F.floor(minute_of_day(t) / minutes) * minutes).cast("int"))).cast("timestamp_ntz")


def to_zone(ts: ColumnOrName, source: str, target: str = "Asia/Kolkata") -> Column:
    """FUN-8: local time of the target zone from a naive time of the source zone."""
    return F.convert_timezone(F.lit(source), F.lit(target), col(ts))


# ---------------------------------------------------------------- strings


def contract_fields(symbol: ColumnOrName) -> Column:
    """FUN-1: struct(underlying, expiry, strike, side) of UNDERLYING DD MON YY[YY] STRIKE CE|PE; null if it doesn't fit.

    The year has four digits if what follows the month starts with 20 and holds nine digits or more.
    """
    s = F.upper(F.trim(col(symbol)))
    rest = F.regexp_extract(s, r"^[A-Z&]+?\d{1,2}[A-Z]{3}(\d+)(?:CE|PE)$", 1)
    long_year = rest.startswith("20") & (F.length(rest) >= 9)
    head = r"^([A-Z&]+?)(\d{1,2})([A-Z]{3})\d+(CE|PE)$"
    year = F.when(long_year, F.substring(rest, 1, 4)).otherwise(F.concat(F.lit("20"), F.substring(rest, 1, 2)))
    strike = F.when(long_year, F.substring(rest, 5, 20)).otherwise(F.substring(rest, 3, 20))
    month = F.initcap(F.regexp_extract(s, head, 3))
    expiry = F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(F.regexp_extract(s, head, 2), 2, "0"), month, year), F.lit("dd-MMM-yyyy")))
    fields = F.struct(F.regexp_extract(s, head, 1).alias("underlying"), expiry.alias("expiry"), strike.try_cast("double").alias("strike"), F.regexp_extract(s, head, 4).alias("side"))
    return F.when(s.rlike(head) & expiry.isNotNull() & (F.length(strike) > 0), fields)


def repaired_contract(strike: ColumnOrName, side: ColumnOrName, symbol: ColumnOrName, least_strike: float = 10_000.0) -> Column:
    """FUN-1: strike if at least least_strike, side if CE or PE, else what the symbol says; the expiry of the symbol."""
    c = contract_fields(symbol)
    good = number(strike) >= least_strike
    label = F.upper(F.trim(col(side)))
    return F.struct(F.when(good, number(strike)).otherwise(c["strike"]).alias("strike"), F.when(label.isin("CE", "PE"), label).otherwise(c["side"]).alias("side"), c["expiry"].alias("expiry"))


def underlying_of(symbol: ColumnOrName) -> Column:
    """FUN-2: leading letters of the symbol."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(col(symbol))), r"^([A-Z&]+)", 1), F.lit(""))


def is_future(symbol: ColumnOrName) -> Column:
    return F.upper(F.trim(col(symbol))).endswith("FUT")


def reason_token(reason: ColumnOrName, key: str) -> Column:
    """FUN-3: the value of key=value, ended by a comma, a space or a bar."""
    return F.nullif(F.regexp_extract(col(reason), rf"(?:^|[\s,|]){re.escape(key)}=([^,\s|]*)", 1), F.lit(""))


def reason_head(reason: ColumnOrName) -> Column:
    """FUN-3: struct(regime, strategy) of '[regime] strategy: ...'."""
    p = r"^\[([^\]]*)\]\s*([^:]*):"
    return F.when(col(reason).rlike(p), F.struct(F.regexp_extract(col(reason), p, 1).alias("regime"), F.regexp_extract(col(reason), p, 2).alias("strategy")))


def reason_code(c: ColumnOrName, aliases: Mapping[str, str] | None = None) -> Column:
    """FUN-4: lower, runs of other characters to _, trimmed, aliased; empty is null."""
    x = F.nullif(F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9_]+", "_"), F.lit("_")), F.lit(""))
    if aliases:
        table = F.create_map(*(F.lit(v) for kv in aliases.items() for v in kv))
        x = F.coalesce(F.try_element_at(table, x), x)
    return x


# ---------------------------------------------------------------- options


def parse_expiry(c: ColumnOrName, day: ColumnOrName) -> Column:
    """FUN-6: yyyy-MM-dd, ddMMMyy or yyyyMMdd, else the next Thursday on or after the day."""
    s = F.initcap(F.trim(col(c)))
    known = [F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in ("yyyy-MM-dd", "ddMMMyy", "yyyyMMdd")]
    return F.coalesce(*known, F.next_day(F.date_sub(col(day), 1), "THU"))


def days_to_expiry(expiry: ColumnOrName, day: ColumnOrName) -> Column:
    return F.greatest(F.lit(0), F.datediff(col(expiry), col(day)))


def years_to_expiry(expiry: ColumnOrName, ts: ColumnOrName, close_minute: int = 930) -> Column:
    """FUN-7: to the close of the expiry day, at least a minute."""
    end = F.unix_timestamp(col(expiry).cast("timestamp")) + close_minute * 60
    return F.greatest(F.lit(60.0), (end - F.unix_timestamp(col(ts).cast("timestamp"))).cast("double")) / 31_536_000.0


def normal_iv(iv: ColumnOrName) -> Column:
    """FUN-11: percent to fraction above 3; null at 0 and below."""
    x = col(iv)
    return F.when(x > 3, x / 100).when(x > 0, x)


def skew_label(skew: ColumnOrName, zone: float = 0.005) -> Column:
    x = col(skew)
    return F.when(x > zone, "PUT_FEAR").when(x < -zone, "CALL_FEAR").when(x.isNotNull(), "NEUTRAL")


def step_rate(day: ColumnOrName, steps: Sequence[tuple[str, float]]) -> Column:
    """FUN-12: the rate of the last step on or before the day; the first before all."""
    out = F.lit(steps[0][1])
    for start, rate in steps:
        out = F.when(col(day) >= F.lit(start).cast("date"), F.lit(rate)).otherwise(out)
    return out


_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: ColumnOrName) -> Column:
    """Rational approximation of Abramowitz and Stegun 26.2.17, error below 7.5e-8; Spark has no erf."""
    x = col(x)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = reduce(lambda acc, c: acc * t + c, reversed(_TAIL), F.lit(0.0)) * t
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def normal_pdf(x: ColumnOrName) -> Column:
    return F.exp(-col(x) * col(x) / 2) / math.sqrt(2 * math.pi)


def option_value(spot: Column, strike: Column, years: Column, rate: Column, vol: Column, call: Column) -> Column:
    """FUN-13: Black-Scholes value."""
    root = vol * F.sqrt(years)
    d1 = (F.ln(spot / strike) + (rate + vol * vol / 2) * years) / root
    d2 = d1 - root
    paid = strike * F.exp(-rate * years)
    return F.when(call, spot * normal_cdf(d1) - paid * normal_cdf(d2)).otherwise(paid * normal_cdf(-d2) - spot * normal_cdf(-d1))


def greeks(spot: Column, strike: Column, years: Column, rate: Column, vol: Column, call: Column) -> Column:
    """FUN-13: struct(delta, gamma, theta per day, vega per point)."""
    root = vol * F.sqrt(years)
    d1 = (F.ln(spot / strike) + (rate + vol * vol / 2) * years) / root
    d2, paid, density = d1 - root, strike * F.exp(-rate * years), normal_pdf(d1)
    decay = -spot * density * vol / (2 * F.sqrt(years))
    theta = F.when(call, decay - rate * paid * normal_cdf(d2)).otherwise(decay + rate * paid * normal_cdf(-d2))
    return F.struct(
        F.when(call, normal_cdf(d1)).otherwise(normal_cdf(d1) - 1).alias("delta"), (density / (spot * root)).alias("gamma"), (theta / 365).alias("theta"), (spot * density * F.sqrt(years) / 100).alias("vega")
    )


def implied_vol(price: Column, spot: Column, strike: Column, years: Column, rate: Column, call: Column, steps: int = 40, low: float = 1e-3, high: float = 5.0) -> Column:
    """FUN-13: bisection with a fixed count of steps, on arrays of a batch of rows; null where no volatility gives the price."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers may not have this package
    columns = (price, spot, strike, years, rate, call)
    return F.pandas_udf(_bisection(steps, low, high), "double")(*(c.cast("double") for c in columns))


def _bisection(steps: int, low: float, high: float):
    def value(spot, strike, years, rate, vol, call):
        """option_value."""
        root = vol * np.sqrt(years)
        d1 = (np.log(spot / strike) + (rate + vol * vol / 2) * years) / root
        paid, sign = strike * np.exp(-rate * years), np.where(call == 1, 1.0, -1.0)
        return sign * (spot * _cdf(sign * d1) - paid * _cdf(sign * (d1 - root)))

    def solve(price: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, call: pd.Series) -> pd.Series:
        price, *rest, call = (c.to_numpy(float) for c in (price, spot, strike, years, rate, call))
        with np.errstate(all="ignore"):
            lo, hi = np.full(len(price), low), np.full(len(price), high)
            inside = (price > value(*rest, lo, call)) & (price < value(*rest, hi, call))
            for _ in range(steps):
                mid = (lo + hi) / 2
                above = value(*rest, mid, call) > price
                lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
            return pd.Series(np.where(inside, (lo + hi) / 2, np.nan))

    return solve


def _cdf(x: np.ndarray) -> np.ndarray:
    """normal_cdf of an array."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    upper = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * (reduce(lambda acc, c: acc * t + c, reversed(_TAIL), 0.0) * t)
    return np.where(x >= 0, 1 - upper, upper)


def trading_cost(entry: ColumnOrName, exit_: ColumnOrName, qty: ColumnOrName | float = 1.0, per_order: float = 20.0, charge_bps: float = 2.5, slippage_bps: float = 7.5) -> Column:
    """FUN-14: struct(brokerage, charges, slippage, total) of a round trip."""
    turnover = (col(entry) + col(exit_)) * (col(qty) if isinstance(qty, (str, Column)) else F.lit(qty))
    charges, slip = turnover * charge_bps / 1e4, turnover * slippage_bps / 1e4
    return F.struct(F.lit(2 * per_order).alias("brokerage"), charges.alias("charges"), slip.alias("slippage"), (2 * per_order + charges + slip).alias("total"))


# ---------------------------------------------------------------- books of levels


def padded_levels(levels: ColumnOrName, depth: int = 5) -> Column:
    """FUN-15: exactly depth levels of struct(price, qty, orders); the rest are zeros."""
    zero = F.struct(F.lit(0.0).alias("price"), F.lit(0).alias("qty"), F.lit(0).alias("orders"))
    have = F.coalesce(col(levels), F.array().cast("array<struct<price:double,qty:int,orders:int>>"))
    return F.slice(F.concat(have, F.array_repeat(zero, depth)), 1, depth)


def book_metrics(bids: ColumnOrName, asks: ColumnOrName, depth: int = 5) -> Column:
    """FUN-15: best prices, mid, spread, microprice, total quantities and imbalance."""
    b, a = padded_levels(bids, depth), padded_levels(asks, depth)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v["qty"])
    bp, ap, bq, aq = b[0]["price"], a[0]["price"], b[0]["qty"], a[0]["qty"]
    two = (bp > 0) & (ap > 0)
    tb, ta = total(b), total(a)
    return F.struct(
        F.when(bp > 0, bp).alias("bid"), F.when(ap > 0, ap).alias("ask"), F.when(two, (bp + ap) / 2).alias("mid"), F.when(two, ap - bp).alias("spread"),
        F.when(two & (bq + aq > 0), (bp * aq + ap * bq) / (bq + aq)).alias("microprice"), tb.alias("bid_qty"), ta.alias("ask_qty"), safe_divide(tb - ta, tb + ta).alias("imbalance"),
    )


def print_side(price: ColumnOrName, mid: ColumnOrName) -> Column:
    """FUN-16: at or above the mid is a buy."""
    return F.when(col(price) >= col(mid), "BUY").when(col(price) < col(mid), "SELL")


# ---------------------------------------------------------------- labels and regimes


def path_label(reason: ColumnOrName) -> Column:
    """FUN-17: 1 for a target (also when both were touched in one bar), 0 for a stop, null for a time stop or an invalid path."""
    r = col(reason)
    return F.when(r.isin("tp", "tp_sl_same_bar"), 1).when(r == "sl", 0)


def result_label(pnl: ColumnOrName) -> Column:
    return F.when(col(pnl) > 0, "WIN").when(col(pnl) < 0, "LOSS").when(col(pnl).isNotNull(), "FLAT")


def regime_flags(vol: ColumnOrName, vol_high: float, trend: ColumnOrName, zone: float, expiry: ColumnOrName) -> Column:
    """FUN-18: 0/1 flags as doubles; a null measure gives a null flag."""
    t = col(trend)
    flag = lambda c: F.when(c, 1.0).when(~c, 0.0)
    return F.struct(flag(col(vol) >= vol_high).alias("vol_high"), flag(t > zone).alias("trend_up"), flag(t < -zone).alias("trend_down"), flag(F.coalesce(col(expiry), F.lit(False))).alias("expiry"))


def first_true(cases: Sequence[tuple[str, Column]], default: str) -> Column:
    """FUN-19, FUN-20: the label of the first case that holds; null conditions don't hold."""
    out = F.lit(default)
    for label, cond in reversed(cases):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def classify(scores: Mapping[str, Column], guards: Sequence[tuple[str, Column]] = (), least: float = 0.0, default: str = "UNCERTAIN") -> Column:
    """FUN-20: guards in order, else the best-scored class; struct(label, confidence, evidence map)."""
    best = F.array_sort(F.array(*(F.struct((-F.coalesce(s, F.lit(0.0))).alias("k"), F.lit(n).alias("label")) for n, s in scores.items())))[0]
    scored = F.when(-best["k"] > least, best["label"]).otherwise(default)
    label = first_true(guards, "") if guards else F.lit("")
    return F.struct(
        F.when(label != "", label).otherwise(scored).alias("label"), F.when(label != "", F.lit(1.0)).otherwise(-best["k"]).alias("confidence"), F.create_map(*(x for n, s in scores.items() for x in (F.lit(n), s.cast("double")))).alias("evidence")
    )


def majority(votes: Sequence[Column], up: str, down: str, tiebreak: Column) -> Column:
    """FUN-21: sum of -1/0/1 votes; a tie goes to the tiebreak."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in votes])
    return F.when(total > 0, up).when(total < 0, down).otherwise(tiebreak)


def alignment(*moves: Column) -> Column:
    """FUN-22: ALIGNED_UP / ALIGNED_DOWN if all moves agree, else MIXED; null if any is null."""
    a = F.array(*moves)
    some = F.exists(a, lambda x: x.isNull())
    return F.when(some, F.lit(None).cast("string")).when(F.forall(a, lambda x: x > 0), "ALIGNED_UP").when(F.forall(a, lambda x: x < 0), "ALIGNED_DOWN").otherwise("MIXED")


# ---------------------------------------------------------------- predicates


_OPERATORS = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def condition(rule: Mapping[str, object]) -> Column:
    """FLT-6: {column, operator, value} where value is a literal or {"column": name}; null compares false."""
    value = rule["value"]
    right = F.col(value["column"]) if isinstance(value, Mapping) else F.lit(value)
    return F.coalesce(_OPERATORS[rule["operator"]](F.col(rule["column"]), right), F.lit(False))


def all_of(rules: Sequence[Mapping[str, object]]) -> Column:
    """FLT-7: empty is true."""
    return reduce(lambda a, b: a & b, map(condition, rules), F.lit(True))


def any_of(rules: Sequence[Mapping[str, object]]) -> Column:
    """FLT-7: empty is false."""
    return reduce(lambda a, b: a | b, map(condition, rules), F.lit(False))


def rule_signal(rule: Mapping[str, object]) -> Column:
    """FLT-7, UDF-1: entry conditions hold, no disqualifier does, and no group of disqualifiers holds as a whole."""
    out = all_of(rule.get("entry_conditions", ())) & ~any_of(rule.get("disqualifiers", ()))
    for group in rule.get("disqualifier_all_of", ()):
        out = out & ~all_of(group)
    return out


def json_text(df: DataFrame, *columns: str) -> Column:
    """FUN-23."""
    return F.to_json(F.struct(*(columns or df.columns)))


def first_match(array: ColumnOrName, test) -> Column:
    """FUN-23: the first element that passes, else null."""
    return F.get(F.filter(col(array), test), F.lit(0))


def slope(values: ColumnOrName, normal: bool = True) -> Column:
    """FUN-10: least-squares slope of an array's non-null values over their index, divided by |first| if normal."""
    v = F.filter(col(values), lambda x: x.isNotNull())
    n = F.size(v).cast("double")
    sums = F.aggregate(
        F.transform(v, lambda x, i: F.struct(i.cast("double").alias("i"), x.cast("double").alias("x"))),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("ix")),
        lambda a, e: F.struct((a["x"] + e["x"]).alias("x"), (a["ix"] + e["i"] * e["x"]).alias("ix")),
    )
    mean = (n - 1) / 2
    raw = F.when(n >= 2, (sums["ix"] - mean * sums["x"]) / (n * (n * n - 1) / 12))
    first = F.abs(F.get(v, F.lit(0)))
    return F.when(first > 0, raw / first) if normal else raw


# ---------------------------------------------------------------- nested rows


def flattened(df: DataFrame, blocks: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-7: the fields of struct columns side by side; of fields with one name the last block's counts."""
    fields = {f.name: F.col(b).getField(f.name) for b in blocks for f in df.schema[b].dataType.fields}
    return df.select(*(k for k in keep if k not in fields), *(c.alias(n) for n, c in fields.items()))


def view(df: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """PRJ-8: named fields, each (path, type); a path that isn't there is null."""

    def there(path: str) -> bool:
        kind = df.schema
        for part in path.split("."):
            if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
                return False
            kind = kind[part].dataType
        return True

    return df.select(*((F.col(p) if there(p) else F.lit(None)).cast(t).alias(n) for n, (p, t) in fields.items()))


def flat_projection(df: DataFrame, columns: Mapping[str, tuple[Sequence[str], Column | None]], types: Mapping[str, str]) -> DataFrame:
    """PRJ-9: each column from the first of its names that is a column, then from its fallback expression where that is null."""
    out = []
    for name, (names, fallback) in columns.items():
        found = next((F.col(n) for n in names if n in df.columns), None)
        parts = [c for c in (found, fallback) if c is not None] or [F.lit(None)]
        out.append(F.coalesce(*parts).cast(types.get(name, "double")).alias(name))
    return df.select(*out)
