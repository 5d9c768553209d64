"""Data-quality operators (DQC family): every one is one aggregation and returns counts, not rows on the driver."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import over, running


def schema_problems(df: DataFrame, required: Sequence[str], removed: Sequence[str] = (), removed_patterns: Sequence[str] = ()) -> list[str]:
    """DQC-1: messages about missing and forbidden columns; reads the schema only."""
    out = [f"missing {c}" for c in required if c not in df.columns]
    return out + [f"forbidden {c}" for c in df.columns if c in removed or any(re.fullmatch(p, c) for p in removed_patterns)]


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DQC-2: rows in repeated groups, and rows beyond the first of each."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_repeated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.count("*").alias("repeated_keys"))


def value_violations(df: DataFrame, constants: Mapping[str, object] | None = None, allowed: Mapping[str, Sequence[object]] | None = None, timestamps: Sequence[str] = ()) -> DataFrame:
    """DQC-3: rows that break each rule; null breaks it."""
    bad: dict[str, Column] = {}
    for c, v in (constants or {}).items():
        bad[f"{c}_constant"] = ~F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    for c, vs in (allowed or {}).items():
        bad[f"{c}_allowed"] = ~F.coalesce(F.col(c).isin(*vs), F.lit(False))
    for c in timestamps:
        bad[f"{c}_timestamp"] = F.try_to_timestamp(F.col(c).cast("string")).isNull()
    return df.agg(F.count("*").alias("rows"), *(F.count_if(b).alias(n) for n, b in bad.items()))


def not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DQC-4: nulls, NaNs and infinities of each column."""
    x = lambda c: F.col(c).cast("double")
    return df.agg(*(F.count_if(x(c).isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf"))).alias(c) for c in columns))


def completeness(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rules: Mapping[str, int], least: float = 0.98, eligible: Column | None = None, day: str | None = None,
    sessions: Mapping[str, int] | None = None, continuity: Mapping[str, Column] | None = None, thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """DQC-5: per keys and column: eligible rows (after the column's warm-up rows), filled share, whether it reaches the least.

    sessions: days of history that a column needs; with `day`, the first days up to that number are left out for it (the day with that
    number counts).  continuity: a further condition of a column's rows, such as the row before having the same strike
    (same_strike).  thresholds: another least share of a column.
    """
    sessions, continuity, thresholds = sessions or {}, continuity or {}, thresholds or {}
    w = over(keys, order)
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_e", F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True))
    df = df.withColumns({f"_e_{c}": F.coalesce(x, F.lit(False)) for c, x in continuity.items()})
    if sessions:
        days = df.select(F.col(day).alias("_day")).distinct().withColumn("_number", F.row_number().over(Window.orderBy("_day")))  # a row per day
        df = df.join(days, df[day].eqNullSafe(days["_day"])).drop("_day")
    old = lambda c: F.col("_number") >= sessions[c] if c in sessions else F.lit(True)
    more = lambda c: F.col(f"_e_{c}") if c in continuity else F.lit(True)
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("filled"), (F.col("_e") & (F.col("_i") > n) & old(c) & more(c)).alias("eligible"), F.lit(float(thresholds.get(c, least))).alias("least")) for c, n in rules.items()))
    g = df.select(*keys, F.explode(items).alias("x")).where("x.eligible").groupBy(*keys, F.col("x.column").alias("column"))
    g = g.agg(F.count("*").alias("eligible"), F.avg(F.col("x.filled").cast("double")).alias("filled"), F.first("x.least").alias("_least"))
    return g.withColumn("ok", F.col("filled") >= F.col("_least")).drop("_least")


def same_strike(strike: str, rows: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """DQC-5: the strike is that of the row before, and there are option rows."""
    return (F.col(strike) == F.lag(strike).over(over(keys, order))) & (F.col(rows) > 0)


def missing_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DQC-7, PRJ-14: null share of each column, one row per column, one pass."""
    a = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return a.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_rate")) for c in columns))).alias("x")).select("x.*")


def drop_sparse(df: DataFrame, columns: Sequence[str], most: float) -> DataFrame:
    """PRJ-14: without the columns whose null share is above `most`; the rates come to the driver, one number a column."""
    rates = {r.column: r.missing_rate for r in missing_rates(df, columns).collect()}
    return df.drop(*(c for c, r in rates.items() if r is not None and r > most))


def clock_leaks(df: DataFrame, minute: str, cut: int, columns: Sequence[str], after_least: float = 0.95, before_most: float = 0.05) -> DataFrame:
    """DQC-8: per column the filled shares before and from the cut, and whether it is valid: filled after, empty before."""
    early = F.col(minute) < cut
    a = df.agg(*(F.struct(F.lit(c).alias("column"), F.avg(F.when(early, F.col(c).isNotNull().cast("double"))).alias("before"), F.avg(F.when(~early, F.col(c).isNotNull().cast("double"))).alias("after")).alias(f"_{i}") for i, c in enumerate(columns)))
    x = a.select(F.explode(F.array(*(f"_{i}" for i in range(len(columns))))).alias("x")).select("x.*")
    return x.withColumn("ok", (F.coalesce("before", F.lit(0.0)) <= before_most) & (F.coalesce("after", F.lit(1.0)) >= after_least))


def row_count_bands(df: DataFrame, day: str, ok: int, warn: int) -> DataFrame:
    """DQC-9."""
    g = df.groupBy(day).agg(F.count("*").alias("rows"))
    return g.withColumn("status", F.when(F.col("rows") >= ok, "OK").when(F.col("rows") >= warn, "WARN").otherwise("ERROR"))


def empty_field_days(df: DataFrame, day: str, fields: Sequence[str]) -> DataFrame:
    """DQC-10: days on which some field has no value, and which."""
    g = df.groupBy(day).agg(*(F.count(f).alias(f) for f in fields))
    lost = F.filter(F.array(*(F.when(F.col(f) == 0, F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return g.withColumn("empty_fields", F.array_join(lost, ",")).where("empty_fields <> ''").select(day, "empty_fields")


def off_version_days(df: DataFrame, day: str, version: str, wanted: str) -> DataFrame:
    """DQC-10."""
    g = df.groupBy(day).agg(F.min(version).alias("lowest"), F.max(version).alias("highest"), F.count_if(F.col(version).isNull()).alias("nulls"))
    return g.where(~F.coalesce((F.col("lowest") == wanted) & (F.col("highest") == wanted) & (F.col("nulls") == 0), F.lit(False)))


def latest_block(days: DataFrame, day: str, good: str, gap: int, keys: Sequence[str] = ()) -> DataFrame:
    """DQC-11: the last run of good days (of each key): a bad day inside it or a calendar gap above `gap` ends it; bad days after
    the last good one are ignored.  First and last day, number of days; a row per day goes in."""
    w, whole = Window.partitionBy(*keys).orderBy(day), Window.partitionBy(*keys)
    d = days.withColumn("_last", F.max(F.when(F.col(good), F.col(day))).over(whole)).where(F.col(day) <= F.col("_last"))
    broken = ~F.col(good) | F.coalesce(F.datediff(F.col(day), F.lag(day).over(w)) > gap, F.lit(False)) | F.coalesce(~F.lag(good).over(w), F.lit(False))
    d = d.withColumn("_g", F.sum(broken.cast("int")).over(running(w))).where(good)
    d = d.withColumn("_top", F.max("_g").over(whole)).where("_g = _top")
    return d.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days"))


def readiness(summary: DataFrame, least_rows: int, least_days: int) -> DataFrame:
    """DQC-12: checks on a dataset summary row."""
    return summary.withColumns({"enough_rows": F.col("rows") >= least_rows, "enough_days": F.col("days") >= least_days, "ready": (F.col("rows") >= least_rows) & (F.col("days") >= least_days)})


def diagnostics(df: DataFrame, keys: Sequence[str], counters: Mapping[str, Column]) -> DataFrame:
    """DQC-13: how often each condition holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in counters.items()))


def label_sanity(df: DataFrame, keys: Sequence[str], label: str, premium: str, skipped: str, low: float, high: float, most_skipped: float) -> DataFrame:
    """DQC-14: positive rate, mean premium and skip rate per group, and whether they are within bounds."""
    g = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(F.col(label).cast("double")).alias("positive_rate"), F.avg(premium).alias("mean_premium"), F.avg(F.col(skipped).isNotNull().cast("double")).alias("skip_rate"))
    return g.withColumn("ok", F.coalesce(F.col("positive_rate").between(low, high) & (F.col("skip_rate") <= most_skipped), F.lit(False)))


def structure_errors(df: DataFrame, required: Sequence[str], lists: Mapping[str, Sequence[str]] | None = None) -> Column:
    """DQC-15: array of messages: required (nested) fields that are null, list items that lack fields."""
    found = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    for c, fields in (lists or {}).items():
        for f in fields:
            found.append(F.when(F.exists(c, lambda x: x[f].isNull()), F.lit(f"{c} has items without {f}")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())
