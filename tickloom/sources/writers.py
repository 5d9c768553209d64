"""Sinks (SNK family)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import latest

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return f"{root.rstrip('/')}/tickloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back: what it was made from isn't computed again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_days(df: DataFrame, root: str, day: str, order: Sequence[str] = ()) -> None:
    """SNK-1, SNK-2: replace exactly the days that df holds; other days stay.  One folder per day, rows in order."""
    out = df.repartition(day)
    out = out.sortWithinPartitions(day, *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(root)


def pending_days(requested: DataFrame, outputs: Sequence[DataFrame], day: str) -> DataFrame:
    """SNK-3: requested days that aren't in all of the outputs."""
    done = outputs[0].select(day).distinct()
    for o in outputs[1:]:
        done = done.intersect(o.select(day).distinct())
    return requested.select(day).distinct().join(done, day, "left_anti")


def identity(*candidates: str) -> Column:
    """SNK-4: the first candidate that isn't empty."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in candidates))


def upserted(current: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SNK-4, STR-5: the keyed table after a batch: the latest row of each key; batches may come again."""
    rows = batch if current is None else current.unionByName(batch, allowMissingColumns=True)
    return latest(rows, keys, order)


def write_by_type(df: DataFrame, root: str, kind: str) -> None:
    """SNK-5, STR-6: append, a folder per event type."""
    df.write.mode("append").partitionBy(kind).parquet(root)


def retained(df: DataFrame, day: str, days: int, today: Column | None = None) -> DataFrame:
    """SNK-6: rows not older than `days`; today may be given."""
    return df.where(F.col(day) >= F.date_sub(today if today is not None else F.current_date(), days))


def split(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """SNK-7: labels and skipped rows."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def as_messages(df: DataFrame, key: str, **constants: str) -> DataFrame:
    """SNK-8: key and JSON value of each row, as a message sink takes them."""
    body = F.struct(*df.columns, *(F.lit(v).alias(k) for k, v in constants.items()))
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))
