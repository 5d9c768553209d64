"""Streaming jobs (STR family).  Event time has a watermark; rows behind it are dropped by Spark and counted in its metrics."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import book_metrics
from ..sources.writers import scratch, upserted


def parsed(df: DataFrame, value: str, schema: str, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """STR-1: valid envelopes as columns, and the rest as text for a side sink."""
    x = df.withColumn("_e", F.from_json(value, schema))
    good = F.lit(True)
    for r in required:
        good = good & F.col(f"_e.{r}").isNotNull()
    x = x.withColumn("_good", F.coalesce(good, F.lit(False)))
    return x.where("_good").select("_e.*"), x.where("not _good").select(value)


def deduplicated(df: DataFrame, ts: str, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """STR-2: the first of equal keys within the watermark."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def tick_bars(df: DataFrame, ts: str, keys: Sequence[str], price: str, tie: str, width: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """STR-7: bars of each tumbling window and key; prices at or below 0 are left out."""
    o = F.struct(ts, tie)
    g = df.where(F.col(price) > 0).withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *keys)
    return g.agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, o).alias("close"), F.count("*").alias("n")).select(F.col("w.start").alias("bar_ts"), *keys, "open", "high", "low", "close", "n")


def sliding_counts(df: DataFrame, ts: str, keys: Sequence[str], width: str, slide: str, delay: str) -> DataFrame:
    """Sliding windows with a late-data rule."""
    return df.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, ts: str, keys: Sequence[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """STR-3: sessions that end after a gap."""
    return df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def assembled_traces(df: DataFrame, trace: str, stage: str, ts: str, payload: str) -> DataFrame:
    """STR-9: one row per trace: stages in time order, the last payload of each stage as a map, first and last time."""
    ordered = F.array_sort(F.collect_list(F.struct(ts, stage, payload)))
    g = df.groupBy(trace).agg(ordered.alias("_s"))
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform("_s", lambda s: s[stage])), lambda k: F.struct(k, F.element_at(F.filter("_s", lambda s: s[stage] == k), -1)[payload])))
    return g.select(trace, F.array_join(F.transform("_s", lambda s: s[stage]), ">").alias("path"), last.alias("payloads"), F.col("_s")[0][ts].alias("first_ts"), F.element_at("_s", -1)[ts].alias("last_ts"))


def outcome(stage: str, ok: str, reason: str) -> Column:
    """STR-10."""
    return F.when(F.col(ok), F.concat_ws(":", stage, F.lit("pass"))).otherwise(F.concat_ws(":", stage, F.coalesce(reason, F.lit("block"))))


def depth_rows(df: DataFrame, bids: str, asks: str) -> DataFrame:
    """STR-13: polls with the metrics of their book; stateless."""
    return df.withColumn("book", book_metrics(bids, asks)).select(*(c for c in df.columns if c not in (bids, asks)), "book.*")


def freshness(df: DataFrame, kind: str, ts: str, now: Column | None = None) -> DataFrame:
    """STR-15: latest time of each type and its age in seconds against `now` (by default the latest of all)."""
    g = df.groupBy(kind).agg(F.max(ts).alias("latest"), F.count("*").alias("n"))
    if now is None:
        now = F.max("latest").over(_all())
    return g.withColumn("age_seconds", F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("latest").cast("timestamp")))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def open_positions(df: DataFrame, ident: str, event: str, order: Sequence[str], values: Sequence[str], close: str = "CLOSE") -> DataFrame:
    """STR-16, SRT-11: the latest event of each id unless it is a close; also in update mode."""
    g = df.groupBy(ident).agg(F.max_by(F.struct(event, *values), F.struct(*order)).alias("r"))
    return g.where(F.col(f"r.{event}") != close).select(ident, "r.*")


def run_to_table(df: DataFrame, name: str, mode: str = "append", folder: str | None = None, days: bool = False) -> DataFrame:
    """STR-4: run a bounded stream to its end (availableNow) into a table of the shared folder and read it.  folder: where an append
    run keeps its rows and, in `checkpoint`, its place, so that it can go on there.  days: the source gives a day at each
    trigger (sources.replay); the run ends when it has no more."""
    spark = df.sparkSession
    path, place = (f"{folder}/rows", f"{folder}/checkpoint") if folder else (scratch(spark, name), scratch(spark, f"{name}-checkpoint"))
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", place)
        if days:
            run = writer.trigger(processingTime="0 seconds").start()
            try:
                run.processAllAvailable()
            finally:
                run.stop()
        else:
            writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(path)
    versions: list[str] = []

    def keep(batch: DataFrame, n: int) -> None:  # complete mode: a batch is the whole result
        target = f"{path}/v{n}"
        batch.write.mode("overwrite").parquet(target)
        versions.append(target)

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(versions[-1]) if versions else spark.createDataFrame([], df.schema)


#: Buckets of a keyed table; a micro-batch rewrites those that it has keys of.
BUCKETS = 64


def run_upserts(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """STR-5, SNK-4: fold each micro-batch into a keyed table and read it.

    Rows are in buckets by a hash of the key, each with versions named by the batch that wrote them; a
    batch reads and writes its own buckets only, then commits their list.  All of it is on disk in
    `folder`, so a query that is started again there goes on, and a batch that runs again writes the same.
    """
    spark = df.sparkSession
    path = folder or scratch(spark, name)
    rows, commits = f"{path}/rows", f"{path}/commits"
    spark.createDataFrame([], df.schema).write.mode("ignore").parquet(f"{rows}/_bucket=-1/_version=-1")
    spark.createDataFrame([], "_bucket int, _version long").write.mode("ignore").parquet(f"{commits}/batch=-1")
    schema = T.StructType([*df.schema.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("_version", T.LongType())])

    def current(before: int | None = None) -> DataFrame:
        done = spark.read.schema("_bucket int, _version long, batch long").parquet(commits)
        done = done.where(F.col("batch") < before) if before is not None else done
        last = done.groupBy("_bucket").agg(F.max("_version").alias("_version"))
        return spark.read.schema(schema).parquet(rows).join(F.broadcast(last), ["_bucket", "_version"])  # a row per bucket

    def fold(batch: DataFrame, n: int) -> None:
        batch = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = batch.select("_bucket").distinct().persist()
        try:
            old = current(n).drop("_version").join(F.broadcast(touched), "_bucket", "left_semi")  # at most one row per bucket
            new = upserted(old.select(batch.columns), batch, keys, order).withColumn("_version", F.lit(n).cast("long"))
            new.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_version").parquet(rows)
            touched.withColumn("_version", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{commits}/batch={n}")
        finally:
            touched.unpersist()

    df.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return current().drop("_bucket", "_version")


class RollingFeatures(StatefulProcessor):
    """STR-8, STR-14, STR-18: running features of each instrument and session: EMA, high, low, VWAP, return, RSI and ATR (Wilder,
    by ticks), and the structure of the last pivots (two rows on both sides).  A session's key ends its state; what carries
    over sessions comes by with_daily_context."""

    def __init__(self, span: int = 9, n: int = 14):
        self.alpha, self.n = 2.0 / (span + 1), n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "features", "ema double, high double, low double, pv double, v double, last double, n long, gain double, loss double, atr double, tail array<double>, highs array<double>, lows array<double>"
        )

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get() if self.state.exists() else (None, None, None, 0.0, 0.0, None, 0, None, None, None, [], [], [])
        ema, high, low, pv, v, last, n, gain, loss, atr, tail, highs, lows = held
        tail, highs, lows = list(tail), list(highs), list(lows)
        smooth = lambda y, x: x if y is None else y + (x - y) / self.n
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for event, x, volume in zip(frame["event_id"].tolist(), frame["price"].astype(float).tolist(), frame["volume"].astype(float).tolist(), strict=True):
            ema = x if ema is None else ema + self.alpha * (x - ema)
            high, low = (x, x) if high is None else (max(high, x), min(low, x))
            pv, v, n = pv + x * volume, v + volume, n + 1
            move = 0.0 if last is None else x - last
            if last is not None:
                gain, loss = smooth(gain, max(move, 0.0)), smooth(loss, max(-move, 0.0))
            atr = smooth(atr, abs(move))
            tail = [*tail[-4:], x]
            if len(tail) == 5:
                if tail[2] == max(tail):
                    highs = [*highs[-1:], tail[2]]
                if tail[2] == min(tail):
                    lows = [*lows[-1:], tail[2]]
            structure = "MIXED"
            if len(highs) == len(lows) == 2:
                up, down = highs[1] > highs[0] and lows[1] > lows[0], highs[1] < highs[0] and lows[1] < lows[0]
                structure = "HH_HL" if up else "LH_LL" if down else "MIXED"
            rsi = 100 - 100 / (1 + gain / loss) if n > self.n and loss else None
            out.append((*key, event, ema, high, low, pv / v if v else None, None if last is None or last == 0 else x / last - 1, rsi, atr, structure, n))
            last = x
        self.state.update((ema, high, low, pv, v, last, n, gain, loss, atr, tail, highs, lows))
        yield pd.DataFrame(out, columns=["instrument", "session", "event_id", "ema", "day_high", "day_low", "vwap", "ret", "rsi", "atr", "structure", "bar"])

    def close(self) -> None:
        pass


FEATURES_SCHEMA = "instrument string, session string, event_id long, ema double, day_high double, day_low double, vwap double, ret double, rsi double, atr double, structure string, bar long"


def _stateful(df: DataFrame) -> None:
    """What stateful Python needs: the RocksDB store, and this module sent by value, as workers may not have it."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rolling_features(df: DataFrame, span: int = 9) -> DataFrame:
    """A stream of (instrument, session, ts, event_id, price, volume) with running features.  Needs the RocksDB state store."""
    _stateful(df)
    return df.groupBy("instrument", "session").transformWithStateInPandas(RollingFeatures(span), FEATURES_SCHEMA, "append", "None")


class CutoffEnricher(StatefulProcessor):
    """STR-11: collects a session's values before the cut-off minute and attaches their summary to the rows from it on."""

    def __init__(self, start: int, cut: int):
        self.start, self.cut = start, cut

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("morning", "n long, first double, last double, high double, low double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, first, last, high, low = self.state.get() if self.state.exists() else (0, None, None, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples(index=False):
            x = float(r.price)
            if self.start <= r.minute < self.cut:
                n, first, last = n + 1, x if first is None else first, x
                high, low = (x, x) if high is None else (max(high, x), min(low, x))
            late = r.minute >= self.cut and n > 0
            out.append((*key, r.event_id, n if late else None, last - first if late else None, high - low if late else None))
        self.state.update((n, first, last, high, low))
        yield pd.DataFrame(out, columns=["instrument", "session", "event_id", "morning_rows", "morning_change", "morning_range"]).astype({"morning_rows": "Int64"})

    def close(self) -> None:
        pass


def cutoff_enriched(df: DataFrame, start: int, cut: int) -> DataFrame:
    """A stream of (instrument, session, ts, event_id, minute, price) with the summary of [start, cut) on rows from cut on."""
    _stateful(df)
    return df.groupBy("instrument", "session").transformWithStateInPandas(CutoffEnricher(start, cut), "instrument string, session string, event_id long, morning_rows long, morning_change double, morning_range double", "append", "None")


def with_daily_context(df: DataFrame, daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """STR-12: stream-static join to a daily table."""
    return df.join(daily, list(keys), "left")
