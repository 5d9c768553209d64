"""Model-facing jobs (MLJ family) on pyspark.ml; purged walk-forward, the clipper as an Estimator and trade utility are in training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writers import stored
from .evaluate import auc_brier
from .select import walk_forward


def clip_bounds(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, keys: Sequence[str] = ()) -> DataFrame:
    """MLJ-1, fit: two quantiles per column (<c>_lo, <c>_hi), one row (per keys)."""
    return df.groupBy(*keys).agg(*(F.percentile(c, p).alias(f"{c}_{n}") for c in columns for n, p in (("lo", low), ("hi", high))))


def clipped(df: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """MLJ-1, transform; nulls stay."""
    out = df.crossJoin(F.broadcast(bounds))  # one row
    return out.select(*(F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"{c}_hi")), F.col(f"{c}_lo"))).alias(c) if c in columns else F.col(c) for c in df.columns))


def classifier(features: Sequence[str], label: str) -> Pipeline:
    """MLJ-2: median imputation, scaling, logistic regression."""
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(features), outputCols=[f"{f}_i" for f in features]), VectorAssembler(inputCols=[f"{f}_i" for f in features], outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01),
        ]
    )


def scored(model: PipelineModel, df: DataFrame, features: Sequence[str], strict: bool = True) -> DataFrame:
    """MLJ-3: probability of class 1; a missing feature column is an error, or null if not strict."""
    missing = [f for f in features if f not in df.columns]
    if missing and strict:
        raise ValueError(f"missing features {missing}")
    x = df.withColumns({f: F.lit(None).cast("double") for f in missing})
    return model.transform(x).select(*df.columns, vector_to_array("probability")[1].alias("p"))


def gated(gate: str, direction: str):
    """MLJ-4: probabilities of up and down moves from a gate's and a direction's."""
    g, d = F.col(gate), F.col(direction)
    return F.struct((g * d).alias("up"), (g * (1 - d)).alias("down"))


def walk_forward_scores(df: DataFrame, day: str, features: Sequence[str], label: str, train: int, valid: int, test: int, step: int) -> DataFrame:
    """MLJ-2, MLJ-5: (fold, rows of the test days, p); a model per fold, fitted on clipped training days.  The folds come to
    the driver (a few), rows don't.  The table is stored first, as every fit goes over it many times."""
    df = stored(df, "walk-forward-rows")
    folds = walk_forward(df.select(day).distinct(), day, train, valid, test, step).cache()
    ids = [r.fold for r in folds.select("fold").distinct().orderBy("fold").collect()]
    out = None
    for f in ids:
        mine = folds.where(F.col("fold") == f)
        pick = lambda role, mine=mine: df.join(F.broadcast(mine.where(F.col("role") == role).select(day)), day, "left_semi")
        learn = pick("train")
        bounds = clip_bounds(learn, features)
        model = classifier(features, label).fit(clipped(learn, bounds, features))
        one = scored(model, clipped(pick("test"), bounds, features), features).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


def fold_quality(scores: DataFrame, label: str) -> DataFrame:
    """MLJ-2: area under the curve and Brier score per fold, best first, and an edge verdict."""
    q = auc_brier(scores, "p", label, ["fold"])
    return q.withColumn("edge", F.when(F.col("auc") >= 0.55, "EDGE").when(F.col("auc") >= 0.5, "WEAK").otherwise("NONE")).orderBy(F.desc("auc"), "fold")
