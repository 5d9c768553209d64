"""Training over time (MLJ family): a clipper for pipelines, purged walk-forward with a final refit, trade utility over folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import stored
from .evaluate import auc_brier, profit_factor
from .joins import purge_overlaps
from .scans import differences_long
from .select import walk_forward
from .windows import over, running


class _Clipping(HasInputCols):
    lower = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)


def _number(c: str) -> Column:
    """A column as a double; infinite and NaN are null."""
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


class QuantileClipper(Estimator, _Clipping, DefaultParamsReadable, DefaultParamsWritable):
    """MLJ-1: learns two quantiles of each input column (linear between values; nulls, NaN and infinities are left out)."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, lower: float = 0.01, upper: float = 0.99):  # noqa: N803
        super().__init__()
        self._setDefault(lower=0.01, upper=0.99)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> QuantileClipperModel:
        columns, at = self.getInputCols(), [self.getOrDefault(self.lower), self.getOrDefault(self.upper)]
        row = dataset.agg(*(F.percentile(_number(c), F.array(*map(F.lit, at))).alias(f"q{i}") for i, c in enumerate(columns))).first()
        lows, highs = ([float("nan") if q is None else q[j] for q in row] for j in (0, 1))
        return self._copyValues(QuantileClipperModel()._set(lows=lows, highs=highs))


class QuantileClipperModel(Model, _Clipping, DefaultParamsReadable, DefaultParamsWritable):
    """Input columns, clipped in place; a column without values to learn from isn't, one that isn't there is passed over."""

    lows = Param(Params._dummy(), "lows", "bound below of each column", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "bound above of each column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bounds = zip(self.getInputCols(), self.getOrDefault(self.lows), self.getOrDefault(self.highs), strict=True)
        clip = lambda c, lo, hi: F.when(_number(c).isNotNull(), F.greatest(F.least(_number(c), F.lit(hi)), F.lit(lo)))
        return dataset.withColumns({c: clip(c, lo, hi) if lo == lo else _number(c) for c, lo, hi in bounds if c in dataset.columns})


def candidates(features: Sequence[str], label: str) -> dict[str, Pipeline]:
    """MLJ-2: clip, median imputation, then scaled logistic regression, or boosted trees."""
    filled = [f"{f}__filled" for f in features]
    clip, impute = QuantileClipper(inputCols=list(features)), Imputer(strategy="median", inputCols=list(features), outputCols=filled)
    raw = VectorAssembler(inputCols=filled, outputCol="__raw")
    scale = StandardScaler(inputCol="__raw", outputCol="__features", withMean=True)
    return {
        "gbt": Pipeline(stages=[clip, impute, raw, GBTClassifier(featuresCol="__raw", labelCol=label, maxIter=10, maxDepth=3, seed=7)]),
        "logistic": Pipeline(stages=[clip, impute, raw, scale, LogisticRegression(featuresCol="__features", labelCol=label, maxIter=20, regParam=0.01)]),
    }


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with p, the probability of class 1; a column p of df is replaced."""
    kept = [c for c in df.columns if c not in ("p", "probability", "prediction", "rawPrediction")]
    originals = {f"{c}__given": F.col(c) for c in kept}
    out = model.transform(df.select(*kept).withColumns(originals))
    return out.select(*(F.col(f"{c}__given").alias(c) for c in kept), vector_to_array("probability")[1].alias("p"))


def median_step(df: DataFrame, ts: str) -> float:
    """Seconds between neighbours in time, the median; 60 if there is none above 0."""
    x = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("t is not null").withColumn("b", F.floor(F.col("t") / 86_400_000_000))
    step = differences_long(x, "t", [], "b", ["t"], "d").agg(F.median("d").alias("m")).first().m
    return step / 1e6 if step and step > 0 else 60.0


def event_purged(train: DataFrame, held: DataFrame, ts: str, end: str, embargo_rows: int = 0) -> DataFrame:
    """MLJ-2, JOI-16: train rows whose closed [ts, end] meets no held-out one; with an embargo only those that also end before
    the first held-out row by more than so many median steps.  A null end is the row's time; rows without a time go."""
    whole = lambda d: d.where(F.col(ts).isNotNull()).withColumn("_end", F.coalesce(end, ts))
    train, held = whole(train), whole(held)
    kept = purge_overlaps(train.withColumn("_all", F.lit(1)), held.withColumn("_all", F.lit(1)), ["_all"], ts, "_end")
    first = held.agg(F.min(ts).alias("t")).first().t
    if embargo_rows > 0 and first is not None:
        cut = F.unix_micros(F.lit(first).cast("timestamp")) - int(median_step(train, ts) * 1e6) * embargo_rows
        kept = kept.where(F.unix_micros(F.col("_end").cast("timestamp")) < cut)
    return kept.drop("_all", "_end")


@dataclass
class WalkForward:
    """What a walk gave: scores (candidate, fold, the rows of the fold's test days, p), stored; the leaderboard; and the best candidate
    fitted on all rows."""

    scores: DataFrame
    leaderboard: DataFrame
    best: str
    model: PipelineModel


def walk_forward_training(
    df: DataFrame, day: str, ts: str, end: str, features: Sequence[str], label: str, train: int, valid: int, test: int, step: int, models: Mapping[str, Pipeline] | None = None, embargo_rows: int = 0, parallel: int = 4
) -> WalkForward:
    """MLJ-2, MLJ-5: each candidate is fitted on every fold's train days less the rows whose [ts, end] reaches into its validation or
    test rows (event_purged), and scores the test days.  Fits run side by side, each a job of its own whose scores are stored, so no
    plan holds all folds.  The leaderboard has mean and spread over the folds of area under the curve and Brier score; the first is fitted
    again on all rows.  Folds come to the driver (a row each, few)."""
    models = dict(models or candidates(features, label))
    folds = stored(walk_forward(df.select(day).distinct(), day, train, valid, test, step), "folds")
    ids = [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()]
    if not ids:
        raise ValueError("too few days for a fold")

    def rows(fold: int, *roles: str) -> DataFrame:
        days = folds.where((F.col("fold") == fold) & F.col("role").isin(*roles)).select(day)
        return df.join(days, day, "left_semi")

    def fit(task: tuple[str, int]) -> DataFrame:
        name, fold = task
        learn = stored(event_purged(rows(fold, "train"), rows(fold, "valid", "test"), ts, end, embargo_rows), "train-rows")
        out = predicted(models[name].fit(learn), rows(fold, "test"))
        return stored(out.withColumns({"fold": F.lit(fold), "candidate": F.lit(name)}), "fold-scores")

    with ThreadPool(parallel) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(fit), [(m, f) for m in models for f in ids])
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    board = stored(leaderboard(scores, label), "leaderboard")
    best = board.orderBy(F.desc_nulls_last("auc_mean"), "brier_mean", "candidate").first().candidate
    return WalkForward(scores, board, best, models[best].fit(df))


def leaderboard(scores: DataFrame, label: str) -> DataFrame:
    """MLJ-2: folds, rows, and mean and population spread over folds of AUC and Brier score for each candidate; folds of one class have no
    area."""
    q = auc_brier(scores, "p", label, ["candidate", "fold"])
    both = [f(c).alias(f"{c}_{n}") for c in ("auc", "brier") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return q.groupBy("candidate").agg(F.count("*").alias("folds"), F.sum("rows").alias("rows"), *both)


@dataclass(frozen=True)
class TradingObjective:
    """MLJ-6: thresholds of the two sides, the returns of path reasons, costs and constraints."""

    ce_threshold: float = 0.5
    pe_threshold: float = 0.5
    take_profit_pct: float = 0.05
    stop_loss_pct: float = 0.05
    cost_per_trade: float = 0.0
    discard_time_stop: bool = False
    risk_per_trade_pct: float = 0.01
    min_trades: int = 1
    min_profit_factor: float = 1.0
    max_equity_drawdown_pct: float = 1.0


def trade_side(ce: str, pe: str, o: TradingObjective) -> Column:
    """MLJ-6: the side whose score reaches its threshold; of both the greater, then CE; null for none."""
    up, down = F.coalesce(F.col(ce) >= o.ce_threshold, F.lit(False)), F.coalesce(F.col(pe) >= o.pe_threshold, F.lit(False))
    return F.when(up & down, F.when(F.col(ce) >= F.col(pe), "CE").otherwise("PE")).when(up, "CE").when(down, "PE")


def path_return(prefix: str, columns: Sequence[str], o: TradingObjective) -> Column:
    """MLJ-6: the realised return if there is one, else that of the reason, else the forward return; time stops may be left out (null)."""
    reason = F.lower(F.trim(F.col(f"{prefix}_path_exit_reason")))
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) if c in columns else F.lit(None).cast("double")
    stopped = (F.coalesce(reason, F.lit("")) == "time_stop") & F.lit(o.discard_time_stop)
    known = F.when(reason.isin("tp", "tp_sl_same_bar"), o.take_profit_pct).when(reason == "sl", -o.stop_loss_pct)
    return F.when(~stopped, F.coalesce(finite(f"{prefix}_realized_return"), known, finite(f"{prefix}_forward_return")))


def scaled_drawdown(df: DataFrame, ret: str, keys: Sequence[str], block: str, order: Sequence[str], scale: float, least: float = 1e-9) -> DataFrame:
    """SCN-8, risk-scaled: the deepest fall of an equity of 1 that each trade changes by its return times `scale`, no less than
    -0.99, and that never falls below `least`: max_drawdown for each key.

    In logarithms a sum with a floor, that is the plain sum raised by the most it has been below the floor.  Blocks (folds, days) are
    summed apart and meet in windows over a row per block.
    """
    floor = F.lit(least)
    ln = df.select(*keys, block, *order, F.log(1 + F.greatest(F.col(ret) * scale, F.lit(-0.99))).alias("_x"))
    w = running(over([*keys, block], order))
    ln = ln.withColumn("_p", F.sum("_x").over(w))
    per = ln.groupBy(*keys, block).agg(F.sum("_x").alias("_t"), F.min("_p").alias("_m"))
    before = over(keys, [block]).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0.0)))
    per = per.withColumn("_low", F.min(F.col("_off") + F.col("_m")).over(before))
    at = [*keys, block]
    starts = per.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(at)), "_off", "_low")
    both = ln.join(starts, [ln[c].eqNullSafe(starts[f"_k{i}"]) for i, c in enumerate(at)])
    total = F.col("_off") + F.col("_p")
    lowest = F.least(F.coalesce("_low", F.lit(float("inf"))), F.min(total).over(w))
    equity = F.exp(total + F.greatest(F.lit(0.0), F.log(floor) - lowest))
    both = both.withColumn("_e", equity).withColumn("_top", F.max("_e").over(w))
    tops = both.groupBy(*keys, block).agg(F.max("_e").alias("_b")).withColumn("_peak", F.coalesce(F.max("_b").over(before), F.lit(1.0)))
    peaks = tops.select(*(F.col(c).alias(f"_q{i}") for i, c in enumerate(at)), "_peak")
    falls = both.join(peaks, [both[c].eqNullSafe(peaks[f"_q{i}"]) for i, c in enumerate(at)])
    fall = 1 - F.col("_e") / F.greatest(F.lit(1.0), "_peak", "_top")
    return falls.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(fall)).alias("max_drawdown"))


def trade_utility(scores: DataFrame, fold: str, order: Sequence[str], o: TradingObjective, ce: str = "ce_prob", pe: str = "pe_prob") -> DataFrame:
    """MLJ-6: what trading the scores would have given: a row for each fold and one of all (fold null, with the verdict constraints_pass).

    scores: one row for each fold and time with ce_ and pe_ _path_exit_reason, _forward_return and, if there, _realized_return.
    Folds follow each other in order; a fold without trades has zeros; profit factor is 999 without losses, 0 without trades.
    """
    side = trade_side(ce, pe, o)
    gross = F.when(side == "CE", path_return("ce", scores.columns, o)).when(side == "PE", path_return("pe", scores.columns, o))
    trades = stored(scores.select(fold, *order, (gross - o.cost_per_trade).alias("net")).where("net is not null"), "trades")
    scale = o.risk_per_trade_pct / max(o.stop_loss_pct, 1e-12)
    gain = F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0.0))
    measures = [
        F.count("net").alias("trades"), F.coalesce(F.sum("net"), F.lit(0.0)).alias("net_return_sum"), F.coalesce(F.avg("net"), F.lit(0.0)).alias("mean_net_return"),
        F.coalesce(profit_factor("net"), F.when(gain > 0, 999.0), F.lit(0.0)).alias("profit_factor"), F.coalesce(F.avg((F.col("net") > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
    ]
    none = F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown")
    per = scores.select(fold).distinct().join(trades, fold, "left").groupBy(fold).agg(*measures)
    per = per.join(scaled_drawdown(trades.withColumn("_one", F.lit(1)), "net", [fold], "_one", order, scale), fold, "left")
    per = per.select(fold, "trades", "net_return_sum", "mean_net_return", "profit_factor", "win_rate", none, F.lit(None).cast("boolean").alias("constraints_pass"))
    deep = scaled_drawdown(trades.withColumn("_all", F.lit(1)), "net", ["_all"], fold, order, scale)
    whole = trades.withColumn("_all", F.lit(1)).groupBy("_all").agg(*measures).join(deep, "_all")
    kinds = dict(scores.dtypes)
    good = (F.col("trades") >= o.min_trades) & (F.col("profit_factor") >= o.min_profit_factor) & (F.col("max_drawdown") <= o.max_equity_drawdown_pct)
    whole = whole.select(F.lit(None).cast(kinds[fold]).alias(fold), "trades", "net_return_sum", "mean_net_return", "profit_factor", "win_rate", none, good.alias("constraints_pass"))
    return per.unionByName(whole)


def edge_verdict(board: DataFrame, edge: float = 0.55) -> DataFrame:
    """MLJ-5: EDGE, WEAK or NONE of each candidate by its mean area."""
    return board.withColumn("verdict", F.when(F.col("auc_mean") >= edge, "EDGE").when(F.col("auc_mean") >= 0.5, "WEAK").otherwise("NONE"))
