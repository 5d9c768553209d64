"""Streams over tables in many files and micro-batches, in any order and day by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers
from ..sources.replay import replayed
from ..sources.writers import scratch, write_days
from ..streaming import event_time as EV
from ..streaming import jobs as ST
from .catalogue import query, rounded
from .views import BARS, bars

TICKS = ["instrument", "ts", "event_id", "price", "volume"]


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("instrument", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "price", F.col("volume").cast("double").alias("volume"))


def shuffled_files(ticks: DataFrame, files: int) -> tuple[DataFrame, str]:
    """The rows in so many files, each with rows of all times, as a stream of a file a micro-batch; then a row without a key that takes
    the watermark past all.  Also the delay that lets every row in."""
    spark, path = ticks.sparkSession, scratch(ticks.sparkSession, "ticks")
    ends = ticks.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    days = (ends.b - ends.a).days + 2 if ends.a else 1
    ticks.repartition(files, F.xxhash64("event_id")).write.parquet(path)
    last = F.lit(ends.b).cast("timestamp_ntz") + F.make_dt_interval(F.lit(days + 2))
    spark.range(1, numPartitions=1).select(*(last.alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in ticks.schema)).write.mode("append").parquet(path)
    return readers.stream(spark, path, ticks.schema, 1), f"{days} days"


FEATURES = BARS + """, o AS (SELECT *, lag(price) OVER w AS last, lag(price, 5) OVER w AS p5, row_number() OVER w AS bar,
    CASE WHEN count(*) OVER f = 5 AND price = max(price) OVER f THEN price END AS ph, CASE WHEN count(*) OVER f = 5 AND price = min(price) OVER f THEN price END AS pl FROM bars
  WINDOW w AS (PARTITION BY session, instrument ORDER BY ts, event_id), f AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
x AS (SELECT *, list(price) OVER w AS ps, list(coalesce(greatest(price - last, 0.0), 0.0)) OVER w AS gs, list(coalesce(greatest(last - price, 0.0), 0.0)) OVER w AS ls,
    list(abs(price - last)) FILTER (last IS NOT NULL) OVER w AS rs, max(price) OVER w AS hi, min(price) OVER w AS lo, sum(price * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap,
    count(volume) OVER v AS nv, avg(volume) OVER v AS mv, stddev_pop(volume) OVER v AS sv, list(ph) FILTER (ph IS NOT NULL) OVER s AS phs, list(pl) FILTER (pl IS NOT NULL) OVER s AS pls FROM o
  WINDOW w AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS 19 PRECEDING),
    s AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
y AS (SELECT *, list_reduce(ps, lambda y, x: x * 0.2 + y * 0.8) AS e9, list_reduce(ps, lambda y, x: x * (2 / 22) + y * (1 - 2 / 22)) AS e21, list_reduce(gs, lambda y, x: y + (x - y) / 14) AS g,
    list_reduce(ls, lambda y, x: y + (x - y) / 14) AS l, CASE WHEN bar > 14 THEN list_reduce(list_concat([list_sum(rs[1:14]) / 14], rs[15:]), lambda y, x: y + (x - y) / 14) END AS atr FROM x),
d AS (SELECT instrument, session, last(atr ORDER BY bar) AS atr FROM y WHERE atr IS NOT NULL GROUP BY ALL),
h AS (SELECT instrument, session, list(atr) OVER (PARTITION BY instrument ORDER BY session ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS past FROM d)
SELECT instrument, session, event_id, bar, round((price - last) / nullif(last, 0), 6) AS ret_1, round((price - p5) / nullif(p5, 0), 6) AS ret_5, round(e9 - e21, 6) AS ema_spread,
  round(e9 - lag(e9) OVER (PARTITION BY session, instrument ORDER BY bar), 6) AS ema_slope, round(CASE WHEN bar > 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END, 6) AS rsi,
  round(atr / nullif(price, 0), 6) AS atr_ratio, round(CASE WHEN atr IS NOT NULL AND len(past) >= 5 THEN len(list_filter(past, lambda p: p <= atr)) / len(past) END, 6) AS atr_percentile,
  round((price - vwap) / nullif(vwap, 0), 6) AS vwap_distance, round((price - hi) / nullif(hi, 0), 6) AS high_distance, round((price - lo) / nullif(lo, 0), 6) AS low_distance,
  round(CASE WHEN nv >= 5 AND mv > 0 THEN volume / mv END, 6) AS rel_volume, round(CASE WHEN nv >= 5 AND sv > 0 THEN (volume - mv) / sv END, 6) AS volume_z,
  CASE WHEN phs[-1] > phs[-2] AND pls[-1] > pls[-2] THEN 'HH_HL' WHEN phs[-1] < phs[-2] AND pls[-1] < pls[-2] THEN 'LH_LL' ELSE 'MIXED' END AS structure
FROM y LEFT JOIN h USING (instrument, session)"""


def _features(spark: SparkSession, sf: str, files: int) -> DataFrame:
    rows, delay = shuffled_files(_ticks(spark, sf), files)
    return rounded(ST.run_to_table(EV.session_features(rows, delay=delay), "event-time-features"))


@query("str_8_event_time_one_file", "WITH " + FEATURES)
def one_file(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, 1)


@query("str_8_14_18_event_time_six_files", "WITH " + FEATURES)
def six_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows from six micro-batches, each with rows of every day."""
    return _features(spark, sf, 6)


def replay_features(ticks: DataFrame, folder: str, stop: str | None = None) -> DataFrame:
    """Features of a table that `folder` has by days, replayed day by day; with stop, only up to that day: a second call goes on after it."""
    spark = ticks.sparkSession
    last = ticks.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at")).first().at or 0
    source = replayed(spark, f"{folder}/table", "day", ticks.schema, f"{folder}/checkpoint", stop, ("ts", last + 3 * 86_400_000_000))
    return ST.run_to_table(EV.session_features(source, delay="1 hour"), "replay", folder=folder, days=True)


@query("str_17_replay_by_day", "WITH " + FEATURES)
def replay(spark: SparkSession, sf: str) -> DataFrame:
    """The events table replayed a day a micro-batch, stopped in the middle and started again."""
    ticks, folder = _ticks(spark, sf), scratch(spark, "replay")
    write_days(ticks.withColumn("day", F.to_date("ts").cast("string")), f"{folder}/table", "day", ["ts", "event_id"])
    middle = ticks.select(F.percentile_approx(F.unix_date(F.to_date("ts")), 0.5).alias("d")).select(F.date_from_unix_date("d").cast("string").alias("d")).first().d
    if middle:
        replay_features(ticks, folder, middle)
    return rounded(replay_features(ticks, folder))


@query(
    "str_11_event_time_six_files",
    "WITH " + BARS + """, m AS (SELECT instrument, session, count(*) AS n, last(price ORDER BY ts, event_id) - first(price ORDER BY ts, event_id) AS c, max(price) - min(price) AS r FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 600 AND 689 GROUP BY ALL),
b AS (SELECT *, hour(ts) * 60 + minute(ts) >= 690 AS late FROM bars)
SELECT b.instrument, b.session, b.event_id, CASE WHEN late THEN m.n END AS morning_rows, round(CASE WHEN late THEN m.c END, 6) AS morning_change, round(CASE WHEN late THEN m.r END, 6) AS morning_range FROM b LEFT JOIN m USING (instrument, session)""",
)
def morning(spark: SparkSession, sf: str) -> DataFrame:
    rows, delay = shuffled_files(_ticks(spark, sf), 6)
    return rounded(ST.run_to_table(EV.morning_summary(rows, 600, 690, delay=delay), "morning"))


@query(
    "str_3_sessions_closed",
    """WITH g AS (SELECT event_type AS instrument, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 1 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY instrument ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT instrument, min(ts) AS first_ts, max(ts) + INTERVAL 1 HOUR AS end_ts, count(*) AS n FROM s GROUP BY instrument, i""",
)
def closed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end an hour after their last event, given out when the watermark has passed that (append mode), from six files."""
    rows, delay = shuffled_files(_ticks(spark, sf), 6)
    s = rows.withColumn("at", F.col("ts").cast("timestamp"))
    out = ST.run_to_table(ST.sessions(s, "at", ["instrument"], "1 hour", delay), "sessions-closed")
    return out.where("instrument is not null").select("instrument", F.col("start").cast("timestamp_ntz").alias("first_ts"), F.col("end").cast("timestamp_ntz").alias("end_ts"), "n")
