"""Trade, score and table aggregations (AGG and EVL families)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ColumnOrName, col, normal_cdf, safe_divide
from .windows import over

# ---------------------------------------------------------------- bars and coverage


def ohlcv(df: DataFrame, keys: Sequence[str], bucket: ColumnOrName, order: Sequence[str], price: str = "price", volume: str = "volume") -> DataFrame:
    """AGG-1, AGG-3: first, highest, lowest, last price and summed volume of each bucket, one shuffle with partial aggregation."""
    o = F.struct(*order)
    return df.groupBy(*keys, col(bucket).alias("bucket")).agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, o).alias("close"), F.sum(volume).alias("volume"), F.count("*").alias("n"))


def field_coverage(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """AGG-4, DQC-16: rows and non-null values of each field; a field that isn't a column counts 0."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *((F.count(f) if f in df.columns else F.lit(0).cast("long")).alias(f"n_{f}") for f in fields))


def text_coverage(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """AGG-5."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count(c).alias("filled"), F.min(c).alias("lowest"), F.max(c).alias("highest"))


def dataset_summary(df: DataFrame, day: str) -> DataFrame:
    """AGG-6."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(day).alias("days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def exists(df: DataFrame, cond: Column) -> bool:
    """AGG-8: stops at the first row."""
    return not df.where(cond).limit(1).isEmpty()


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-27: one row per column: rows, nulls, least, greatest, mean, population spread, infinities, zero variance; one pass."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("spread"), F.count_if(F.abs(x) == float("inf")).alias("infinite"), (F.min(x) == F.max(x)).alias("constant")))
    return df.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("p")).select("p.*")


# ---------------------------------------------------------------- trades


def reconstruct(df: DataFrame, ident: str, event: str, order: Sequence[str], values: Sequence[str], open_: str = "OPEN", close: str = "CLOSE") -> DataFrame:
    """AGG-9: a row per id that has both events: values of the last OPEN (open_*) and the last CLOSE (close_*), events seen."""
    o, row = F.struct(*order), F.struct(*values)
    pick = lambda e: F.max_by(row, F.when(F.col(event) == e, o))
    g = df.groupBy(ident).agg(pick(open_).alias("o"), pick(close).alias("c"), F.count("*").alias("events"), F.count_if(F.col(event) == open_).alias("_no"), F.count_if(F.col(event) == close).alias("_nc")).where("_no > 0 and _nc > 0")
    return g.select(ident, *(F.col(f"o.{v}").alias(f"open_{v}") for v in values), *(F.col(f"c.{v}").alias(f"close_{v}") for v in values), "events")


def profit_factor(ret: ColumnOrName, on_no_loss: float | None = None) -> Column:
    """EVL-1, UDF-3: aggregate: gross profit over gross loss; on_no_loss (null, 999, inf) where nothing was lost."""
    r = col(ret)
    gain, loss = F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r).otherwise(0.0))
    return F.when(loss > 0, gain / loss).otherwise(F.lit(on_no_loss).cast("double"))


def trade_measures(ret: str, mfe: str | None = None, mae: str | None = None, bars: str | None = None) -> list[Column]:
    """AGG-10: the aggregates of a trade summary, to be used under any grouping."""
    r = F.col(ret)
    out = [
        F.count(r).alias("trades"), F.count_if(r > 0).alias("wins"), F.count_if(r < 0).alias("losses"), F.count_if(r == 0).alias("flats"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean_return"), F.median(r).alias("median_return"),
        F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gross_profit"), F.sum(F.when(r < 0, r).otherwise(0.0)).alias("gross_loss"), profit_factor(ret).alias("profit_factor"),
    ]
    if mfe and mae:
        out += [F.avg(mfe).alias("avg_mfe"), F.avg(mae).alias("avg_mae"), safe_divide(F.avg(mfe), F.abs(F.avg(mae))).alias("mfe_mae")]
    return out + ([F.avg(bars).alias("avg_bars")] if bars else [])


def trade_summary(df: DataFrame, keys: Sequence[str], ret: str, **more: str) -> DataFrame:
    """AGG-10, AGG-11, AGG-15: a summary per group; null keys are a group."""
    return df.groupBy(*keys).agg(*trade_measures(ret, **more))


def summary_sets(df: DataFrame, sets: Sequence[Sequence[str]], ret: str) -> DataFrame:
    """AGG-11: several groupings in one pass, as grouping sets; grouping_id tells them apart."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    g = df.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys))
    return g.agg(F.grouping_id().alias("grouping_id"), F.count(ret).alias("trades"), F.sum(ret).alias("net"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"))


def share_breakdown(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-12, AGG-23: count and share of the total of each value."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def distribution_shift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """AGG-23: shares of both tables per value (0 if absent) and their difference."""
    x = share_breakdown(a.where(F.trim(key) != ""), [key]).select(key, F.col("share").alias("share_a"))
    y = share_breakdown(b.where(F.trim(key) != ""), [key]).select(key, F.col("share").alias("share_b"))
    out = x.join(y, key, "full").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("share_a", "share_b")})
    return out.withColumn("shift", F.abs(F.col("share_a") - F.col("share_b")))


def stop_analysis(df: DataFrame, keys: Sequence[str], reason: str, ret: str, mfe: str, stops: Sequence[str]) -> DataFrame:
    """AGG-13: stopped trades, their share, profitable stops, mean gain locked in and its share of the best excursion."""
    stopped = F.col(reason).isin(*stops)
    locked = stopped & (F.col(ret) > 0)
    return df.groupBy(*keys).agg(F.count("*").alias("trades"), F.count_if(stopped).alias("stopped"), F.avg(stopped.cast("double")).alias("stopped_share"), F.count_if(locked).alias("locked"), F.avg(F.when(locked, F.col(ret))).alias("avg_locked"), F.avg(F.when(locked & (F.col(mfe) > 0), F.col(ret) / F.col(mfe))).alias("capture"))


def discover_runs(df: DataFrame, run: str, day: str, cond: Column, limit: int) -> DataFrame:
    """AGG-14: runs with a row that meets the condition, latest first."""
    g = df.groupBy(run).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_if(cond).alias("closed"))
    return g.where("closed > 0").orderBy(F.desc("last_day"), F.desc("closed"), run).limit(limit)


def first_filled(df: DataFrame, keys: Sequence[str], c: str, order: Sequence[str]) -> DataFrame:
    """AGG-16: the first non-empty text of each group."""
    full = F.trim(F.col(c)) != ""
    return df.groupBy(*keys).agg(F.min_by(F.col(c), F.when(full, F.struct(*order))).alias(c))


def gate_funnel(df: DataFrame, gates: str, outcome: str, top: int = 10) -> DataFrame:
    """AGG-17: how often each gate is the first that didn't pass (none: passed), by outcome; the `top` most frequent."""
    blocker = F.coalesce(F.get(F.filter(gates, lambda g: g["status"] != "pass"), F.lit(0))["gate_id"], F.lit("passed"))
    return df.groupBy(outcome, blocker.alias("blocker")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), outcome, "blocker").limit(top)


def gate_counts(df: DataFrame, gates: str) -> DataFrame:
    """AGG-18: pass and block counts of each gate."""
    g = df.select(F.explode(gates).alias("g")).groupBy(F.col("g.gate_id").alias("gate_id"))
    return g.agg(F.count_if(F.col("g.status") == "pass").alias("passed"), F.count_if(F.col("g.status") != "pass").alias("blocked"))


def event_rollup(df: DataFrame, event: str, ts: str, run: str) -> DataFrame:
    """AGG-19: per event its count, first and last time, number of runs."""
    return df.groupBy(event).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_distinct(run).alias("runs"))


def agreement(df: DataFrame, keys: Sequence[str], pred: str, truth: str, other: str, confidence: str) -> DataFrame:
    """AGG-20, EVL-15: share of committed rows (pred not 0), agreement with another, accuracy where there is a truth, confidence."""
    made = F.col(pred) != 0
    ok = made & F.col(truth).isNotNull()
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(made.cast("double")).alias("commit_rate"), F.avg(F.when(made & (F.col(other) != 0), (F.col(pred) == F.col(other)).cast("double"))).alias("agree_rate"), F.avg(F.when(ok, (F.col(pred) == F.col(truth)).cast("double"))).alias("accuracy"), F.avg(confidence).alias("mean_confidence"))


def leaderboard(df: DataFrame, name: str, window: str, net: str, trades: str) -> DataFrame:
    """AGG-21: stability over windows: how many, total, mean, median and worst net, share of positive windows; best first."""
    g = df.groupBy(name).agg(F.count_distinct(window).alias("windows"), F.sum(net).alias("total"), F.avg(net).alias("mean"), F.median(net).alias("median"), F.avg((F.col(net) > 0).cast("double")).alias("positive_share"), F.min(net).alias("worst"), F.sum(trades).alias("trades"))
    return g.orderBy(F.desc("positive_share"), F.desc("median"), F.desc("total"), F.desc("worst"), F.desc("trades"), F.desc("windows"), name)


def segment_report(df: DataFrame, segment: str, names: Sequence[str], ret: str) -> DataFrame:
    """AGG-22: every listed segment, the empty ones with zeros."""
    spark = df.sparkSession
    listed = spark.createDataFrame([(n,) for n in names], [segment])
    g = df.groupBy(segment).agg(F.count("*").alias("rows"), F.sum(ret).alias("net"), profit_factor(ret).alias("profit_factor"))
    total = df.agg(F.count("*").alias("all"))
    out = listed.join(g, segment, "left").crossJoin(F.broadcast(total))  # one row
    return out.select(segment, F.coalesce("rows", F.lit(0)).alias("rows"), safe_divide(F.coalesce("rows", F.lit(0)), "all").alias("share"), F.coalesce("net", F.lit(0.0)).alias("net"), "profit_factor")


def histogram(df: DataFrame, x: str, edges: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """AGG-24: half-open buckets, the last closed; values outside are left out."""
    last = len(edges) - 2
    b = F.lit(None).cast("int")
    for i in reversed(range(last + 1)):
        upper = (F.col(x) <= edges[i + 1]) if i == last else (F.col(x) < edges[i + 1])
        b = F.when((F.col(x) >= edges[i]) & upper, i).otherwise(b)
    return df.withColumn("bucket", b).where("bucket is not null").groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, keys: Sequence[str], x: str, points: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """AGG-25: linear quantiles, mean and population spread."""
    return df.groupBy(*keys).agg(*(F.percentile(x, p).alias(f"p{round(100 * p):02d}") for p in points), F.avg(x).alias("mean"), F.stddev_pop(x).alias("spread"))


def nearest_rank(df: DataFrame, keys: Sequence[str], x: str, points: Sequence[float]) -> DataFrame:
    """AGG-26: sorted[ceil(q n) - 1] by ranks, so that no group is collected."""
    w = Window.partitionBy(*keys)
    r = df.where(F.col(x).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(x))).withColumn("_n", F.count("*").over(w))
    return r.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(p))), F.col(x))).alias(f"q{round(100 * p):02d}") for p in points))


def per_day_counts(df: DataFrame, day: str, cond: Column) -> DataFrame:
    """AGG-28: mean, median and tenths of the number of rows per day that meet the condition (days with none count 0)."""
    g = df.groupBy(day).agg(F.count_if(cond).alias("n"))
    return g.agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.percentile("n", 0.1).alias("p10"), F.percentile("n", 0.9).alias("p90"))


def window_diagnostics(df: DataFrame, keys: Sequence[str], flags: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """AGG-29: mean of flags, median of measures."""
    return df.groupBy(*keys).agg(*(F.avg(F.col(f).cast("double")).alias(f) for f in flags), *(F.median(m).alias(m) for m in measures))


def concentration(df: DataFrame, day: str, ret: str) -> DataFrame:
    """AGG-30: net, share of the best day and the best five, net without them, sum of the worst five, profitable days."""
    d = df.groupBy(day).agg(F.round(F.sum(ret), 9).alias("s"))
    d = d.withColumn("best", F.row_number().over(Window.orderBy(F.desc("s"), day))).withColumn("worst", F.row_number().over(Window.orderBy("s", day)))
    top = lambda c, n: F.sum(F.when(F.col(c) <= n, F.col("s")).otherwise(0.0))
    net = F.sum("s")
    return d.agg(F.count("*").alias("days"), net.alias("net"), safe_divide(top("best", 1), net).alias("top1_share"), safe_divide(top("best", 5), net).alias("top5_share"), (net - top("best", 5)).alias("net_without_top5"), top("worst", 5).alias("worst5"), F.avg((F.col("s") > 0).cast("double")).alias("profitable_days"))


def bucket_table(df: DataFrame, bucket: Column, ret: str, least: int = 1) -> DataFrame:
    """AGG-31, AGG-32: a trade summary per bucket; buckets with fewer than `least` trades are left out."""
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("trades"), F.sum(ret).alias("net"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"), profit_factor(ret).alias("profit_factor")).where(F.col("trades") >= least)


def pass_matrix(df: DataFrame, row: str, name: str, ok: Column, names: Sequence[str]) -> DataFrame:
    """AGG-33: a row per month and a column per rule: PASS, FAIL or null."""
    status = F.when(ok, "PASS").otherwise("FAIL")
    return df.groupBy(row).pivot(name, list(names)).agg(F.min(status))


# ---------------------------------------------------------------- scores


def return_summary(df: DataFrame, keys: Sequence[str], ret: str, traded: Column, side: str) -> DataFrame:
    """EVL-2: trades, block rate, net, profit factor, win rate and share of long trades; scans.max_drawdown has the drawdown, which needs an order."""
    r = F.when(traded, F.col(ret))
    return df.groupBy(*keys).agg(F.count_if(traded).alias("trades"), (1 - F.avg(traded.cast("double"))).alias("block_rate"), F.sum(F.when(traded, F.col(ret)).otherwise(0.0)).alias("net"), profit_factor(r).alias("profit_factor"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(F.when(traded, (F.col(side) == "CE").cast("double"))).alias("long_share"))


def auc_brier(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """EVL-3, EVL-4: area under the curve with average ranks for ties, Brier score, rows, positives; null area with one class.

    Equal scores are counted first, so the window sees one row per distinct score.
    """
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    g = ok.groupBy(*keys, F.col(score).alias("_s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("p"), F.sum((F.col(label) - F.col(score)) ** 2).alias("b"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("rank", before + (F.col("n") + 1) / 2)
    s = g.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum("p").alias("positives"), F.sum(F.col("rank") * F.col("p")).alias("ranks"), F.sum("b").alias("b"))
    p, n = F.col("positives"), F.col("rows") - F.col("positives")
    return s.select(*keys, "rows", p.cast("long").alias("positives"), F.when((p > 0) & (n > 0), (F.col("ranks") - p * (p + 1) / 2) / (p * n)).alias("auc"), (F.col("b") / F.col("rows")).alias("brier"))


def calibration(df: DataFrame, score: str, label: str, tie: Sequence[str], bins: int = 10, equal_count: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """EVL-5, EVL-6: rows, mean score and positive share of each bin; bins of equal count have edges int(i n / bins) of the
    sorted rows, those of equal width are of [0, 1].  Rows are placed inside 4,096 ranges of the score, whose sizes
    are added up, so no task sorts them all."""
    if equal_count:
        part = F.coalesce(F.greatest(F.lit(-1), F.least(F.lit(4096), F.floor(F.col(score) * 4096))), F.lit(-2))
        r = df.withColumn("_b", part)
        whole = Window.partitionBy(*keys)
        before = F.coalesce(F.sum("_c").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = r.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).withColumn("_start", before).withColumn("_n", F.sum("_c").over(whole)).drop("_c")
        r = r.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(score, *tie)) - 1)
        names = [*keys, "_b"]
        ranges = ranges.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(names)), "_start", "_n")
        r = r.join(ranges, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(names)]).withColumn("_i", F.col("_i") + F.col("_start"))
        b = F.floor(((F.col("_i") + 1) * bins - 1) / F.col("_n"))
        bin_ = F.least(F.lit(bins - 1), b)
    else:
        r, bin_ = df, F.least(F.lit(bins - 1), F.floor(F.col(score) * bins))
    return r.groupBy(*keys, bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_share"))


def calibration_error(df: DataFrame, score: str, label: str, tie: Sequence[str], bins: int = 10, equal_count: bool = True) -> DataFrame:
    """EVL-5, EVL-6: mean absolute gap of the bins, weighted by rows."""
    c = calibration(df, score, label, tie, bins, equal_count)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive_share"))) / F.sum("n")).alias("calibration_error"))


def separation(df: DataFrame, score: str, label: str) -> DataFrame:
    """EVL-7: mean and median score of each class and their gaps."""
    one, zero = F.when(F.col(label) == 1, F.col(score)), F.when(F.col(label) == 0, F.col(score))
    return df.agg((F.avg(one) - F.avg(zero)).alias("mean_gap"), (F.median(one) - F.median(zero)).alias("median_gap"), F.avg(one).alias("mean_positive"), F.avg(zero).alias("mean_negative"))


def fire_rates(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """EVL-8: for each threshold the share of rows at or above it and their precision, with the base rate."""
    marked = F.transform(F.array(*map(F.lit, thresholds)), lambda t: F.struct(t.alias("threshold"), (F.col(score) >= t).alias("fired")))
    x = df.select(F.col(label).cast("double").alias("y"), F.explode(marked).alias("m"))
    return x.groupBy(F.col("m.threshold").alias("threshold")).agg(F.avg(F.col("m.fired").cast("double")).alias("fire_rate"), F.avg(F.when(F.col("m.fired"), F.col("y"))).alias("precision"), F.avg("y").alias("base_rate"))


def direction_action(long_p: str, short_p: str, threshold: float, edge: float) -> Column:
    """EVL-9: CE or PE if its probability passes the threshold and leads by the edge, else null."""
    a, b = F.col(long_p), F.col(short_p)
    return F.when((a >= threshold) & (a - b >= edge), "CE").when((b >= threshold) & (b - a >= edge), "PE")


def policy_evaluation(scores: DataFrame, utility: DataFrame, keys: Sequence[str], action: Column, recipe: Column) -> DataFrame:
    """EVL-10, EVL-22: realised return of the chosen (recipe, side) of every row, then its summary."""
    chosen = scores.withColumn("side", action).withColumn("recipe_id", recipe)
    met = chosen.join(utility.select(*keys, "recipe_id", "side", "net_return"), [*keys, "recipe_id", "side"], "left")
    return return_summary(met, [], "net_return", F.col("side").isNotNull() & F.col("net_return").isNotNull(), "side")


def t_statistic(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """EVL-11: n, mean, t and the two-sided normal p-value."""
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return g.withColumn("t", t).withColumn("p_value", 2 * (1 - normal_cdf(F.abs("t")))).drop("sd")


def _resampled(per: DataFrame, unit: str, iterations: int, seed: int) -> DataFrame:
    """A row per iteration that a unit is drawn in: it, and w, a Poisson(1) weight from a hash of both, that a rerun repeats."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(unit).cast("string"), F.col("it").cast("string"))), 1, 7), 16, 10).cast("double") / float(16**7)
    weight, p, tail, k = F.lit(0), math.exp(-1), 0.0, 0
    while tail < 1 - 1e-9:
        tail += p
        weight = weight + (F.col("_u") >= tail).cast("int")
        k += 1
        p /= k
    return per.withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("_u", u).withColumn("w", weight).where("w > 0").drop("_u")


def _interval(x: DataFrame, value: str, keys: Sequence[str], level: float) -> DataFrame:
    a = (1 - level) / 2
    return x.groupBy(*keys).agg(F.count(value).alias("iterations"), F.avg(value).alias("mean"), F.percentile(value, a).alias("low"), F.percentile(value, 1 - a).alias("high"))


def bootstrap_mean(df: DataFrame, unit: str, x: str, iterations: int = 200, seed: int = 3, level: float = 0.95) -> DataFrame:
    """EVL-12, SET-8: interval of the mean by resampling whole units (days).

    Units are summed first; each is exploded to the iterations it has a weight in, so the work is units x iterations.
    """
    per = df.groupBy(unit).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    drawn = _resampled(per, unit, iterations, seed)
    return _interval(drawn.groupBy("it").agg(safe_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m")), "m", (), level)


def bootstrap_profit_factor(df: DataFrame, unit: str, ret: str, iterations: int = 200, seed: int = 3, level: float = 0.95) -> DataFrame:
    """EVL-12: interval of gains over losses; an iteration without losses has none."""
    per = df.groupBy(unit).agg(F.sum(F.when(F.col(ret) > 0, F.col(ret)).otherwise(0.0)).alias("g"), F.sum(F.when(F.col(ret) < 0, -F.col(ret)).otherwise(0.0)).alias("l"))
    drawn = _resampled(per, unit, iterations, seed)
    return _interval(drawn.groupBy("it").agg(safe_divide(F.sum(F.col("w") * F.col("g")), F.sum(F.col("w") * F.col("l"))).alias("m")), "m", (), level)


def bootstrap_auc(df: DataFrame, unit: str, score: str, label: str, iterations: int = 100, seed: int = 3, level: float = 0.95) -> DataFrame:
    """EVL-12: intervals of the area under the curve and of the Brier score, measure by measure, by resampling whole units.
    Equal scores of a unit are counted before they meet the iterations, so the work is their number x iterations."""
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = ok.groupBy(unit, F.col(score).alias("_s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("p"), F.sum((F.col(label) - F.col(score)) ** 2).alias("b"))
    weights = _resampled(ok.select(unit).distinct(), unit, iterations, seed)
    g = per.join(weights, unit).groupBy("it", "_s").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "p", "b")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("it").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = g.withColumn("_r", before + (F.col("n") + 1) / 2).groupBy("it").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("_r") * F.col("p")).alias("r"), F.sum("b").alias("b"))
    auc = safe_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    rows = s.select(F.explode(F.array(F.struct(F.lit("auc").alias("measure"), auc.alias("m")), F.struct(F.lit("brier").alias("measure"), safe_divide("b", "n").alias("m")))).alias("x")).select("x.*")
    return _interval(rows, "m", ["measure"], level)


def half_drift(df: DataFrame, score: str, label: str, half: Column, least: int = 10) -> DataFrame:
    """EVL-3: area and Brier score of both halves of the rows and the differences, later minus earlier; half: 0 or 1 for a row.
    A half of fewer rows than `least` has no area."""
    per = auc_brier(df.withColumn("_half", half), score, label, ["_half"])
    pick = lambda c, h: F.max(F.when(F.col("_half") == h, F.col(c)))
    big = F.when(F.col("rows") >= least, F.col("auc"))
    g = per.withColumn("auc", big).agg(*(pick(c, h).alias(f"{c}_{n}") for c in ("auc", "brier") for h, n in ((0, "first"), (1, "second"))))
    return g.withColumns({"auc_drift": F.col("auc_second") - F.col("auc_first"), "brier_drift": F.col("brier_second") - F.col("brier_first")})


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """EVL-13: a boolean for each check of a summary row, and whether all hold; null fails."""
    out = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()})
    return out.withColumn("passed", F.forall(F.array(*checks), lambda x: x))


def feature_separation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """EVL-14: Cohen's d (pooled population spread) and the rank-sum z of each feature between two classes."""
    x = df.select(F.col(label).cast("int").alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("z")).select("y", "z.*").where("v is not null and y is not null")
    one, zero = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
    m = x.groupBy("feature").agg(F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_pop(one).alias("v1"), F.var_pop(zero).alias("v0"), F.count(one).alias("n1"), F.count(zero).alias("n0"))
    ties = x.groupBy("feature", "v").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    before = F.coalesce(F.sum("n").over(over(["feature"], ["v"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = ties.withColumn("rank", before + (F.col("n") + 1) / 2).groupBy("feature").agg(F.sum(F.col("rank") * F.col("p")).alias("ranks"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    out = m.join(r, "feature")
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    u = F.col("ranks") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return out.select("feature", "n1", "n0", safe_divide(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2)).alias("cohens_d"), F.when(var > 0, (u - n1 * n0 / 2) / F.sqrt(var)).alias("rank_z"))


def separation_stability(df: DataFrame, features: Sequence[str], label: str, window: str) -> DataFrame:
    """EVL-14: per feature over the windows: their number, mean and population spread of Cohen's d, the share of windows
    whose d has the sign of the mean, and the drift of d from the first window to the last."""
    x = df.select(window, F.col(label).cast("int").alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("z")).select(window, "y", "z.*").where("v is not null and y is not null")
    one, zero = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
    per = x.groupBy("feature", window).agg(safe_divide(F.avg(one) - F.avg(zero), F.sqrt((F.var_pop(one) + F.var_pop(zero)) / 2)).alias("d")).where("d is not null")
    whole = Window.partitionBy("feature")
    per = per.withColumn("_same", (F.signum("d") == F.signum(F.avg("d").over(whole))).cast("double"))
    return per.groupBy("feature").agg(F.count("*").alias("windows"), F.avg("d").alias("mean_d"), F.stddev_pop("d").alias("spread_d"), F.avg("_same").alias("sign_share"), (F.max_by("d", window) - F.min_by("d", window)).alias("drift_d"))


def monotone(df: DataFrame, keys: Sequence[str], bucket: str, value: str) -> DataFrame:
    """EVL-16: whether the value never falls from bucket to bucket, and how often it does."""
    d = df.withColumn("_f", (F.col(value) < F.lag(value).over(over(keys, [bucket]))).cast("int"))
    return d.groupBy(*keys).agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("falls"), (F.coalesce(F.sum("_f"), F.lit(0)) == 0).alias("monotone"))


def funnel_levels(df: DataFrame, side: str, levels: dict[str, Column]) -> DataFrame:
    """EVL-17: rows, share of all rows and share of CE at each level of a funnel."""
    marks = F.array(*(F.struct(F.lit(n).alias("level"), F.coalesce(c, F.lit(False)).alias("hit")) for n, c in levels.items()))
    x = df.select(F.col(side).alias("side"), F.explode(marks).alias("m"))
    return x.groupBy(F.col("m.level").alias("level")).agg(F.count_if(F.col("m.hit")).alias("rows"), F.avg(F.col("m.hit").cast("double")).alias("coverage"), F.avg(F.when(F.col("m.hit"), (F.col("side") == "CE").cast("double"))).alias("long_share"))


def side_capture(df: DataFrame, score: str, side: str, truth: str, thresholds: Sequence[float]) -> DataFrame:
    """EVL-18: per threshold and side: rows called, precision, share of the true rows that were called."""
    marked = F.transform(F.array(*map(F.lit, thresholds)), lambda t: F.struct(t.alias("threshold"), (F.col(score) >= t).alias("hit")))
    x = df.select(side, (F.col(truth) == F.col(side)).alias("right"), F.explode(marked).alias("m"))
    return x.groupBy(F.col("m.threshold").alias("threshold"), side).agg(F.count_if(F.col("m.hit")).alias("called"), F.avg(F.when(F.col("m.hit"), F.col("right").cast("double"))).alias("precision"), safe_divide(F.count_if(F.col("m.hit") & F.col("right")), F.count_if(F.col("right"))).alias("capture"))


def recent_quality(df: DataFrame, day: str, n: int, score: str, threshold: float, ret: str) -> DataFrame:
    """EVL-19: over the n latest observed days: trades at or above the threshold, precision, profit factor, calibration gap."""
    days = df.select(day).distinct().orderBy(F.desc(day)).limit(n)
    x = df.join(F.broadcast(days), day, "left_semi")  # n days
    hit = F.col(score) >= threshold
    r = F.when(hit, F.col(ret))
    return x.agg(F.count_distinct(day).alias("days"), F.count_if(hit).alias("trades"), F.avg((r > 0).cast("double")).alias("precision"), profit_factor(r).alias("profit_factor"), F.abs(F.avg(score) - F.avg((F.col(ret) > 0).cast("double"))).alias("calibration_gap"))


def ab_compare(a: DataFrame, b: DataFrame, day: str, ret: str, tolerance: float = 0.0) -> DataFrame:
    """EVL-20: net and trades of both over the days both have, and the winner (tie within the tolerance)."""
    days = a.select(day).distinct().intersect(b.select(day).distinct())
    s = lambda x, n: x.join(days, day, "left_semi").agg(F.count("*").alias(f"trades_{n}"), F.coalesce(F.sum(ret), F.lit(0.0)).alias(f"net_{n}"))
    one = s(a, "a").crossJoin(s(b, "b"))  # one row each
    d = F.col("net_a") - F.col("net_b")
    return one.withColumn("winner", F.when(d > tolerance, "a").when(d < -tolerance, "b").otherwise("tie"))


def capital_metrics(df: DataFrame, entry: str, exit_: str, qty: str, mfe: str, capital: float) -> DataFrame:
    """EVL-21: at_risk, pnl amount, share of the capital, share of the best excursion captured."""
    pnl = (F.col(exit_) - F.col(entry)) * F.col(qty)
    return df.withColumns({"at_risk": F.col(entry) * F.col(qty), "pnl_amount": pnl, "capital_share": pnl / capital, "capture": F.when(F.col(mfe) > 0, (F.col(exit_) / F.col(entry) - 1) / F.col(mfe))})
