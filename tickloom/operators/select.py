"""Top-k, de-duplication, set operations and calendar tables (SRT and SET families)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ColumnOrName, col


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName]) -> DataFrame:
    """SRT-2: the first row of each key in the order (descending time for the last)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SRT-11: the last row of each key, by partial aggregation instead of a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName], n: int) -> DataFrame:
    """SRT-3: rows ranked 1 to n with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def row_score(weights: dict[str, float], absolute: Sequence[str] = ()) -> Column:
    """SRT-3: weighted sum of columns; a missing value adds nothing."""
    return sum((F.coalesce((F.abs(F.col(c)) if c in absolute else F.col(c)) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))


def top_fraction(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], share: float) -> DataFrame:
    """SRT-4, SRT-6: the best max(1, ceil(n * share)) rows of each group, and the least score kept."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_n", F.row_number().over(w.orderBy(F.desc(score), *tie))).withColumn("_k", F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * share)))
    return df.where("_n <= _k").withColumn("score_floor", F.min(score).over(w)).drop("_n", "_k")


def side_capped(df: DataFrame, side: str, score: str, tie: Sequence[str], cap: float, keys: Sequence[str] = ()) -> DataFrame:
    """SRT-5: trim the larger side to floor(cap / (1 - cap) * other), at least 1, by rank; the other side stays."""
    sizes = df.groupBy(*keys, side).agg(F.count("*").alias("_c"))
    other = sizes.withColumn("_all", F.sum("_c").over(Window.partitionBy(*keys)))
    keep = other.select(*keys, side, F.when(F.col("_c") > cap * F.col("_all"), F.greatest(F.lit(1), F.floor(cap / (1 - cap) * (F.col("_all") - F.col("_c"))))).otherwise(F.col("_c")).alias("_keep"))
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, side).orderBy(F.desc(score), *tie)))
    return ranked.join(keep, [*keys, side]).where("_n <= _keep").drop("_n", "_keep")


def best_candidate(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnOrName], valid: Column) -> DataFrame:
    """SRT-7: of the valid candidates of each row the first by the tiebreaks."""
    return keep_one(df.where(valid), keys, order)


def argmax(columns: dict[str, ColumnOrName]) -> Column:
    """SRT-8: struct(name, value, margin) of the largest of named columns; ties by name; nulls last."""
    entries = F.array(*(F.struct((-F.coalesce(col(c).cast("double"), F.lit(float("-inf")))).alias("k"), F.lit(n).alias("n")) for n, c in columns.items()))
    s = F.array_sort(entries)
    return F.struct(s[0]["n"].alias("name"), (-s[0]["k"]).alias("value"), (s[1]["k"] - s[0]["k"]).alias("margin"))


def nearest_value(x: str, target: ColumnOrName) -> Column:
    """SRT-9: aggregate: the value nearest to the target, the lower of two."""
    return F.min_by(F.col(x), F.struct(F.abs(F.col(x) - col(target)), F.col(x)))


def pick_expiry(expiry: str, day: ColumnOrName) -> Column:
    """SRT-10: aggregate: the first expiry on or after the day, else the last before."""
    return F.coalesce(F.min(F.when(F.col(expiry) >= col(day), F.col(expiry))), F.max(expiry))


def nearest_expiries(days: DataFrame, day: str, expiries: DataFrame, expiry: str, out: str = "expiry") -> DataFrame:
    """SRT-10: for every distinct day the first expiry on or after it, else the last one: both sorted once by date and filled
    backwards.  The window sees a row per day and per expiry."""
    both = days.select(F.col(day).alias("_at"), F.lit(None).cast("date").alias("_x")).distinct().unionByName(expiries.select(F.col(expiry).alias("_at"), F.col(expiry).alias("_x")).distinct())
    after = Window.orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    filled = both.withColumn(out, F.coalesce(F.min("_x").over(after), F.max("_x").over(Window.partitionBy())))
    return filled.where("_x is null and _at is not null").select(F.col("_at").alias(day), out)


def page(df: DataFrame, order: Sequence[ColumnOrName], number: int, size: int) -> DataFrame:
    """SRT-12: rows of a page; a page beyond the end is the last one.  Rows are counted, then the first pages up to this one are taken in
    order, which tasks do with the best of their own rows; only those are numbered together."""
    total = df.count()
    p = min(max(1, number), max(1, -(-total // size)))
    top = df.orderBy(*order).limit(p * size).withColumn("row_number", F.row_number().over(Window.orderBy(*order)))
    return top.where(F.col("row_number") > (p - 1) * size).withColumn("total_rows", F.lit(total).cast("long"))


def threshold_grid(df: DataFrame, score: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """SRT-13, EVL-8: for each threshold: rows at or above it, sum and share of positive values; a row is exploded to the
    thresholds it passes only."""
    passed = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(score) >= t)
    g = df.select(F.explode(passed).alias("threshold"), F.col(value).alias("v")).groupBy("threshold")
    return g.agg(F.count("*").alias("trades"), F.sum("v").alias("net"), F.avg((F.col("v") > 0).cast("double")).alias("win_rate"))


def best_threshold(df: DataFrame, score: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """SRT-13: the grid row with the largest net, then most trades, then lowest threshold."""
    return threshold_grid(df, score, value, thresholds).orderBy(F.desc("net"), F.desc("trades"), "threshold").limit(1)


# ---------------------------------------------------------------- sets of days


def common_days(frames: Sequence[DataFrame], day: str) -> DataFrame:
    """SET-2: days present in all tables."""
    out = frames[0].select(day).distinct()
    for f in frames[1:]:
        out = out.intersect(f.select(day).distinct())
    return out


def calendar_windows(df: DataFrame, day: str, mode: str = "month") -> DataFrame:
    """SET-4: first and last observed day of each month, quarter or year, or of all (full)."""
    key = F.lit("full") if mode == "full" else F.date_format(F.date_trunc(mode, F.col(day)), "yyyy-MM-dd")
    return df.select(key.alias("window"), day).groupBy("window").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count_distinct(day).alias("days"))


def walk_forward(days: DataFrame, day: str, train: int, valid: int, test: int, step: int, purge: int = 0, embargo: int = 0) -> DataFrame:
    """SET-5: (fold, role, day): whole folds only; `purge` days are left out before validation and `embargo` before test.
    days has one row per trading day."""
    idx = days.select(day).distinct().withColumn("i", F.row_number().over(Window.orderBy(day)) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    span = train + purge + valid + embargo + test
    starts = F.when(F.col("n") >= span, F.sequence(F.lit(0).cast("long"), F.col("n") - span, F.lit(step).cast("long")))
    rows = idx.withColumn("start", F.explode(starts))
    off = F.col("i") - F.col("start")
    v, t = train + purge, train + purge + valid + embargo
    role = F.when((off >= 0) & (off < train), "train").when((off >= v) & (off < v + valid), "valid").when((off >= t) & (off < span), "test")
    return rows.withColumn("role", role).where("role is not null").select((F.col("start") / step).cast("long").alias("fold"), "role", day)


def split_days(days: DataFrame, day: str, ratios: Sequence[float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """SET-6: train, valid, test by day order; each has at least one day if there are three."""
    idx = days.select(day).distinct().withColumn("i", F.row_number().over(Window.orderBy(day)) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    a = F.greatest(F.lit(1), F.floor(F.col("n") * ratios[0]))
    b = F.greatest(F.lit(1), F.floor(F.col("n") * ratios[1]))
    a = F.when((F.col("n") >= 3) & (a + b >= F.col("n")), F.col("n") - b - 1).otherwise(a)
    return idx.select(day, F.when(F.col("i") < a, "train").when(F.col("i") < a + b, "valid").otherwise("test").alias("split"))


def month_slices(days: DataFrame, day: str, warmup: int) -> DataFrame:
    """SET-7: per month of trading days: first day to read (warmup trading days earlier), first and last day to emit."""
    idx = days.select(day).distinct().withColumn("read_from", F.lag(day, warmup).over(Window.orderBy(day)))
    first = F.min(day).over(Window.partitionBy())
    idx = idx.withColumn("read_from", F.coalesce("read_from", first))
    return idx.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.min_by("read_from", day).alias("read_from"), F.min(day).alias("emit_from"), F.max(day).alias("emit_to"))


def absent_days(df: DataFrame, day: str, skip_weekends: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """AGG-34: calendar days between the first and the last (of each key) that have no row."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    every = ends.where("a is not null").select(*keys, F.explode(F.sequence("a", "b")).alias(day))
    every = every.where(F.weekday(day) < 5) if skip_weekends else every
    return every.join(df.select(*keys, day).distinct(), [*keys, day], "left_anti")
