"""Sources (SRC family)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import col, normalize_columns


def csv_folder(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """SRC-1, SRC-3: CSV files with a header; all strings without a schema.  Files with other columns go in other calls
    and are joined by union_by_name.  pattern: a glob for file names."""
    r = spark.read.option("header", True).option("recursiveFileLookup", recursive)
    r = r.option("pathGlobFilter", pattern) if pattern else r
    r = r.schema(schema) if schema is not None else r
    return r.csv(paths if isinstance(paths, str) else list(paths))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """SET-1: all columns of all tables, nulls where a table lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_path_dates(df: DataFrame) -> DataFrame:
    """SRC-2: year and month from year=/month= or /YYYY/MM/ in the file's path."""
    p = F.col("_metadata.file_path")
    pick = lambda a, b: F.coalesce(F.nullif(F.regexp_extract(p, a, 1), F.lit("")), F.nullif(F.regexp_extract(p, b, 1), F.lit(""))).try_cast("int")
    return df.withColumn("year", pick(r"year=(\d{4})", r"/(\d{4})/\d{1,2}/")).withColumn("month", pick(r"month=(\d{1,2})", r"/\d{4}/(\d{1,2})/"))


def parquet_dataset(spark: SparkSession, root: str, ts: str | None = None, merge_schema: bool = True, schema: StructType | str | None = None) -> DataFrame:
    """SRC-4, SRC-5, SRC-6: a dataset in any folder layout, schemas joined by name; with ts, rows without one are dropped."""
    r = spark.read.option("mergeSchema", merge_schema).option("recursiveFileLookup", False)
    df = (r.schema(schema) if schema is not None else r).parquet(root)
    return df.where(F.col(ts).isNotNull()) if ts else df


def date_range(df: DataFrame, day: str, start: object, end: object, columns: Sequence[str] | None = None) -> DataFrame:
    """SRC-7, SRC-12, FLT-1: inclusive; the filter and the columns reach the scan."""
    df = df.where(F.col(day).between(start, end))
    return df.select(*columns) if columns else df


def feature_table(df: DataFrame, ts: str = "timestamp", day: str = "trade_date") -> DataFrame:
    """SRC-9: ts must be there; the day is derived if it isn't."""
    if ts not in df.columns:
        raise ValueError(f"no column {ts}")
    return df if day in df.columns else df.withColumn(day, F.to_date(ts))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-10: one JSON object per line; lines that don't parse are left out."""
    df = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.where("_bad is null").drop("_bad")


def json_column(df: DataFrame, c: str, schema: str, out: str = "parsed") -> DataFrame:
    """SRC-11: a JSON text as a struct; null if it doesn't parse."""
    return df.withColumn(out, F.from_json(col(c), schema))


def table(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: by suffix: parquet, csv, tsv, json."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "tsv"):
        return normalize_columns(spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("inferSchema", True).csv(path))
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    return spark.read.parquet(path)


def stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100, format_: str = "parquet") -> DataFrame:
    """SRC-13, STR-17: a folder as a stream; the checkpoint of the query is its place in it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format_).load(path)


def before(day: Column | str, value: object) -> Column:
    return col(day) < value
