"""Joins of ordered tables (JOI family), all of them equi-joins or windows underneath."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import stored
from .counting import positions
from .windows import over, running


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], tie: Sequence[str] = (), direction: str = "backward", tolerance: float | None = None, prefix: str = "") -> DataFrame:
    """JOI-1: the last right row at or before each left row (forward: the first at or after), by equal keys.

    Union of both sides and a fill over one window, so it is one shuffle by the keys and no theta join.
    Of right rows with one time the last by `tie` counts; every left row comes out once.  tolerance is in seconds.
    """
    values_ = F.struct(F.col(ts).alias("_ts"), *(F.col(v).alias(v) for v in values))
    l_ = left.select(*by, F.col(ts).alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(values_).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"), *(F.lit(None).cast(dict(right.dtypes)[t]).alias(f"_t{i}") for i, t in enumerate(tie)))
    r_ = right.select(*by, F.col(ts).alias("_at"), F.lit(None).cast(l_.schema["_l"].dataType).alias("_l"), values_.alias("_r"), F.lit(0).alias("_side"), *(F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)))
    ties = [f"_t{i}" for i in range(len(tie))]
    both = l_.unionByName(r_)
    if direction == "backward":
        w = running(over(by, ["_at", "_side", *ties]))
    else:
        w = running(over(by, [F.desc("_at"), "_side", *(F.desc(t) for t in ties)]))
    found = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    match = F.col("_m")
    if tolerance is not None:
        gap = F.abs(F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("_m")["_ts"].cast("timestamp"))) / 1e6
        match = F.when(gap <= tolerance, F.col("_m"))
    return found.withColumn("_m", match).select("_l.*", F.col("_m")["_ts"].alias(f"{prefix}{ts}_matched"), *(F.col("_m")[v].alias(f"{prefix}{v}") for v in values))


def exact_lag(df: DataFrame, keys: Sequence[str], seconds: str, lag: int, values: Sequence[str], suffix: str = "_lagged") -> DataFrame:
    """JOI-2: the values of the row exactly `lag` seconds earlier in the session, else null."""
    past = df.select(*keys, (F.col(seconds) + lag).alias(seconds), *(F.col(v).alias(v + suffix) for v in values)).dropDuplicates([*keys, seconds])
    return df.join(past, [*keys, seconds], "left")


def history_asof(keys: Sequence[str], seconds: str, value: str, least: int, most: int | None = None) -> Column:
    """JOI-3: the last value of the same keys at least `least` and at most `most` seconds ago."""
    start = Window.unboundedPreceding if most is None else -most
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(seconds).rangeBetween(start, -least))


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, values: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """JOI-4: the right row nearest in time; of two equally near the earlier."""
    left = left.withColumn("_row", F.struct(*left.columns))
    back = asof(left, right, by, ts, values, tie, "backward", prefix="b_")
    fore = asof(back, right, by, ts, values, tie, "forward", prefix="f_")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    before, after = micros(ts) - micros(f"b_{ts}_matched"), micros(f"f_{ts}_matched") - micros(ts)
    use_back = before.isNotNull() & (after.isNull() | (before <= after))
    return fore.select("_row.*", F.when(use_back, F.col(f"b_{ts}_matched")).otherwise(F.col(f"f_{ts}_matched")).alias(f"{ts}_matched"), *(F.when(use_back, F.col(f"b_{v}")).otherwise(F.col(f"f_{v}")).alias(v) for v in values))


def add_missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-5: columns that the left lacks; one right row for a key, so that the row count stays."""
    more = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*keys, *more).dropDuplicates(list(keys)), list(keys), "left")


def cardinality(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-6, JOI-7, DQC-6: one row of counts: rows, keys repeated on either side, rows without a partner on either side."""
    l_ = left.groupBy(*keys).agg(F.count("*").alias("nl"))
    r_ = right.groupBy(*keys).agg(F.count("*").alias("nr"))
    both = l_.join(r_, list(keys), "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(
        total("nl").alias("left_rows"), total("nr").alias("right_rows"), F.count_if(F.col("nl") > 1).alias("left_repeated"), F.count_if(F.col("nr") > 1).alias("right_repeated"),
        total(F.when(F.col("nr").isNull(), F.col("nl"))).alias("left_only"), total(F.when(F.col("nl").isNull(), F.col("nr"))).alias("right_only"), total(F.col("nl") * F.col("nr")).alias("joined_rows"),
    )


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-6: inner join that fails at run time on a repeated key of either side."""
    n = F.count("*").over(Window.partitionBy(*keys))
    unique = lambda df: df.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("keys repeat")).cast("boolean"))).where("_ok").drop("_n", "_ok")
    return unique(left).join(unique(right), list(keys))


def all_matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-7: left join that fails at run time if a left row has no partner."""
    joined = left.join(right.withColumn("_hit", F.lit(True)), list(keys), "left")
    return joined.where(F.when(F.col("_hit"), True).otherwise(F.raise_error(F.lit("a row has no partner")).cast("boolean"))).drop("_hit")


def two_sides(df: DataFrame, keys: Sequence[str], side: str, sides: Sequence[str], values: Sequence[str]) -> DataFrame:
    """JOI-8, CHN-1: one row for a key with the values of each side, by conditional aggregation instead of a full join."""
    aggs = [F.max(F.when(F.col(side) == s, F.col(v))).alias(f"{s.lower()}_{v}") for s in sides for v in values]
    return df.groupBy(*keys).agg(*aggs)


def missing_keys(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-9, JOI-21, SET-3, SNK-3: distinct keys of the target that the source lacks."""
    return target.select(*keys).distinct().join(source.select(*keys), list(keys), "left_anti")


def latest_days(df: DataFrame, day: str, n: int, before: Column | None = None) -> DataFrame:
    """JOI-10, SRC-8: rows of the n latest days (before a day)."""
    days = df.select(day).distinct()
    days = (days.where(F.col(day) < before) if before is not None else days).orderBy(F.desc(day)).limit(n)
    return df.join(F.broadcast(days), day, "left_semi")  # n days


def lookup(left: DataFrame, right: DataFrame, on: Mapping[str, str], values: Sequence[str]) -> DataFrame:
    """JOI-11: values of the unique right row whose keys (on: left name -> right name) match; left rows stay."""
    r_ = right.select(*(F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())), *values).dropDuplicates([f"_k{i}" for i in range(len(on))])
    cond = reduce(lambda a, b: a & b, [left[k] == r_[f"_k{i}"] for i, k in enumerate(on)])
    return left.join(r_, cond, "left").drop(*(f"_k{i}" for i in range(len(on))))


def attach_daily(df: DataFrame, daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-12: daily columns onto finer rows; the planner broadcasts the daily table if it is small."""
    return df.join(daily, list(keys), "left")


def merge_outer(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """JOI-13, JOI-14: full outer merge of tables with distinct value columns."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), tables)


def score_table(long: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """JOI-15: a column <value>_<name> for each name."""
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col(name) == n, F.col(value))).alias(f"{value}_{n}") for n in names))


def merged_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping closed intervals, by gaps and islands."""
    w = over(keys, [start, end])
    prior = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", (F.coalesce(F.col(start) > prior, F.lit(True))).cast("int")).withColumn("_g", F.sum("_new").over(running(w)))
    return df.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def purge_overlaps(train: DataFrame, held: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """JOI-16: train rows whose closed [start, end] meets no held-out interval of the same keys.

    Merged held-out intervals don't overlap, so an interval meets one of them exactly if the last that
    starts at or before its end ends at or after its start: an as-of fill instead of a range join.
    """
    blocks = merged_intervals(held.select(*keys, start, end), keys, start, end)
    probe = train.select(*keys, F.col(end).alias("_at"), F.struct(*train.columns).alias("_row"), F.lit(None).cast(dict(train.dtypes)[end]).alias("_end"), F.lit(1).alias("_side"))
    marks = blocks.select(*keys, F.col(start).alias("_at"), F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), F.col(end).alias("_end"), F.lit(0).alias("_side"))
    last_end = F.last("_end", ignorenulls=True).over(running(over(keys, ["_at", "_side"])))
    out = probe.unionByName(marks).withColumn("_last", last_end).where("_side = 1").where(F.col("_last").isNull() | (F.col("_last") < F.col(f"_row.{start}")))
    return out.select("_row.*")


def embargo(train: DataFrame, held: DataFrame, ts: str, seconds: float) -> DataFrame:
    """JOI-16: drop train rows within `seconds` before the first held-out row."""
    first = held.agg(F.min(ts).alias("_first"))
    cut = F.col("_first") - F.make_dt_interval(secs=F.lit(seconds))
    return train.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | ~((F.col(ts) >= cut) & (F.col(ts) < F.col("_first")))).drop("_first")  # one row


#: Intervals that start in one bin of the sweep.
SWEEP_ROWS = 4096


def self_overlaps(df: DataFrame, keys: Sequence[str], ident: str, start: str, end: str, rows: int = SWEEP_ROWS) -> DataFrame:
    """JOI-17: pairs (a, b) of one key whose half-open [start, end) overlap, the earlier (then smaller id) first.

    Bins have `rows` starts each, however dense an hour is.  Intervals that start in one bin are swept in order of
    start: the work is near the number of pairs.  An interval that goes on into later bins meets all that start
    there by an equi-join, which skew handling can split; of these pairs only those of its last bin can fail the test.
    """
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = df.select(*keys, F.col(ident).alias("id"), sec(start).alias("s"), sec(end).alias("e")).where("e > s").dropna(subset=list(keys))
    hour = F.floor(F.col("s") / 3_600_000_000)
    placed = stored(positions(spans.withColumn("_hour", hour), keys, "_hour", ["s", "id"], "_at").withColumn("bin", F.floor(F.col("_at") / rows)).select(*keys, "bin", "id", "s", "e"), "sweep")
    bins = placed.groupBy(*keys, "bin").agg(F.min("s").alias("_lo"))

    def sweep(table: pa.Table) -> pa.Table:
        table = table.sort_by([("s", "ascending"), ("id", "ascending")])
        s, e = table["s"].to_numpy(), table["e"].to_numpy()
        stop = np.searchsorted(s, e, side="left")  # rows after i that start before its end
        n = np.maximum(stop - np.arange(len(s)) - 1, 0)
        a = np.repeat(np.arange(len(s)), n)
        b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left, right = table.take(pa.array(a)), table.take(pa.array(b))
        return pa.table([*(left[k] for k in keys), left["id"], right["id"]], names=[*keys, "a", "b"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"a {kinds[ident]}", f"b {kinds[ident]}"])
    inside = placed.groupBy(*keys, "bin").applyInArrow(sweep, schema)
    # the last bin that starts before an interval's end
    ends = placed.select(*keys, F.col("e").alias("_t"), F.struct("id", "e", "bin").alias("_i"), F.lit(None).cast("long").alias("_b"), F.lit(0).alias("_side"))
    marks = bins.select(*keys, F.col("_lo").alias("_t"), F.lit(None).cast(ends.schema["_i"].dataType).alias("_i"), F.col("bin").alias("_b"), F.lit(1).alias("_side"))
    last = F.max("_b").over(running(over(keys, ["_t", "_side"])))
    far = ends.unionByName(marks).withColumn("_last", last).where("_side = 0 and _last > _i.bin")
    far = far.select(*keys, F.explode(F.sequence(F.col("_i.bin") + 1, "_last")).alias("bin"), F.col("_i.id").alias("a"), F.col("_i.e").alias("_e"))
    across = far.join(placed.select(*keys, "bin", F.col("id").alias("b"), "s"), [*keys, "bin"]).where("s < _e").select(*keys, "a", "b")
    return inside.unionByName(across)


def combine_first(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI-18: the left's rows and values, nulls and missing rows from the right."""
    rest = [c for c in left.columns if c not in keys]
    more = [c for c in right.columns if c not in keys and c not in rest]
    r_ = right.select(*keys, *(F.col(c).alias(f"_r_{c}") for c in (*rest, *more) if c in right.columns))
    out = left.join(r_, list(keys), "full")
    return out.select(*keys, *((F.coalesce(c, f"_r_{c}") if c in right.columns else F.col(c)).alias(c) for c in rest), *(F.col(f"_r_{c}").alias(c) for c in more))


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """JOI-20: keys with status left_only, right_only, changed (any difference above the tolerance) or same, and the largest difference."""
    l_ = left.select(*keys, *(F.col(v).alias(f"_l_{v}") for v in values), F.lit(True).alias("_l"))
    r_ = right.select(*keys, *(F.col(v).alias(f"_r_{v}") for v in values), F.lit(True).alias("_r"))
    gaps = [F.coalesce(F.abs(F.col(f"_l_{v}") - F.col(f"_r_{v}")), F.when(F.col(f"_l_{v}").isNull() & F.col(f"_r_{v}").isNull(), 0.0).otherwise(float("inf"))) for v in values]
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(gap > tolerance, "changed").otherwise("same")
    out = l_.join(r_, list(keys), "full")
    return out.select(*keys, status.alias("status"), F.when(F.col("_l") & F.col("_r"), gap).alias("max_gap"))


def attribute_misses(expected: DataFrame, actual: DataFrame, blockers: DataFrame, keys: Sequence[str], reason: str, default: str = "unknown") -> DataFrame:
    """JOI-21: expected keys that didn't happen, with the reason that blocked them."""
    return missing_keys(expected, actual, keys).join(blockers.select(*keys, reason).dropDuplicates(list(keys)), list(keys), "left").withColumn(reason, F.coalesce(reason, F.lit(default)))


def grid(spark, **axes: Sequence[object]) -> DataFrame:
    """JOI-22: every combination of configuration values; sizes are those of the lists given."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(b), frames)
