"""Stream jobs over several micro-batches: order of arrival, freed state, restarts."""

import datetime as dt

from pyspark.sql import functions as F

from tickloom.plans import stream_queries as SQ
from tickloom.sources import readers
from tickloom.sources.replay import END, DayReader, replayed
from tickloom.sources.writers import scratch, write_days
from tickloom.streaming import event_time as EV
from tickloom.streaming import jobs as ST

DAYS = [dt.datetime(2024, 3, d) for d in (1, 2, 4)]


def ticks(spark, n=40):
    rows = [(k, day + dt.timedelta(minutes=9 * 60 + 10 * i), 1000 * j + 10 * i + (k == "b"), 100.0 + (7 * i * (j + 1)) % 23, float(1 + i % 5)) for k in "ab" for j, day in enumerate(DAYS) for i in range(n)]
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, event_id long, price double, volume double")


def as_stream(spark, parts, closing=None):
    """Each table is a file, and a micro-batch."""
    path = scratch(spark, "parts")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    if closing:
        row = [(None, closing, None, None, None)]
        spark.createDataFrame(row, parts[0].schema).coalesce(1).write.mode("append").parquet(path)
    return readers.stream(spark, path, parts[0].schema, 1)


def test_order_of_arrival_does_not_matter(spark):
    t = ticks(spark)
    parts = [t.where(F.col("event_id") % 4 == i) for i in (2, 0, 3, 1)]
    one = ST.run_to_table(EV.session_features(as_stream(spark, [t], dt.datetime(2024, 4, 1)), delay="10 days"), "one")
    four = ST.run_to_table(EV.session_features(as_stream(spark, parts, dt.datetime(2024, 4, 1)), delay="10 days"), "four")
    assert sorted(map(str, one.collect())) == sorted(map(str, four.collect())) and one.count() == t.count()


def test_late_rows_are_dropped_and_days_in_order_need_little_delay(spark):
    t = ticks(spark)
    by_day = [t.where(F.dayofmonth("ts") == d.day) for d in DAYS]
    late = t.where(F.dayofmonth("ts") == 1).limit(1).withColumn("event_id", F.lit(-1).cast("long"))
    got = ST.run_to_table(EV.session_features(as_stream(spark, [by_day[0], by_day[1], late, by_day[2]], dt.datetime(2024, 4, 1)), delay="5 minutes"), "late")
    whole = ST.run_to_table(EV.session_features(as_stream(spark, [t], dt.datetime(2024, 4, 1)), delay="10 days"), "whole")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_state_is_freed_when_sessions_end(spark):
    t, folder = ticks(spark), scratch(spark, "freed")
    s = as_stream(spark, [t.where(F.dayofmonth("ts") == d.day) for d in DAYS])
    rows = ST.run_to_table(EV.session_features(s, delay="5 minutes"), "freed", folder=folder)
    still = EV.open_state(spark, f"{folder}/checkpoint", "open")
    assert {(r.key.instrument, r.value.session) for r in still.collect()} == {(k, (DAYS[2] - dt.datetime(1970, 1, 1)).days) for k in "ab"}
    waiting = EV.open_state(spark, f"{folder}/checkpoint", "waiting").count()
    assert waiting == t.count() - rows.count() == 2 and EV.open_state(spark, f"{folder}/checkpoint", "daily").count() == 4
    folder = scratch(spark, "closed")
    s = as_stream(spark, [t], dt.datetime(2024, 4, 1))
    ST.run_to_table(EV.morning_summary(s, 600, 690, delay="10 days"), "closed", folder=folder)
    assert EV.open_state(spark, f"{folder}/checkpoint", "open").count() == EV.open_state(spark, f"{folder}/checkpoint", "waiting").count() == 0
    folder = scratch(spark, "windows")
    s = as_stream(spark, [t], dt.datetime(2024, 4, 1)).withColumn("at", F.col("ts").cast("timestamp"))
    out = ST.run_to_table(ST.sessions(s, "at", ["instrument"], "1 hour", "10 days"), "windows", folder=folder)
    assert out.where("instrument is not null").count() == 6 and spark.read.format("statestore").load(f"{folder}/checkpoint").where("key.instrument is not null").count() == 0


def test_rows_that_say_nothing(spark):
    schema = "instrument string, ts timestamp_ntz, event_id long, price double, volume double"
    at = DAYS[0] + dt.timedelta(hours=10)
    odd = spark.createDataFrame([("a", at, None, 1.0, 1.0), ("a", at, 1, None, 1.0), ("a", at, 2, 5.0, None), ("a", at, 3, 0.0, 0.0), (None, at, 4, 1.0, 1.0)], schema)
    got = ST.run_to_table(EV.session_features(as_stream(spark, [odd], dt.datetime(2024, 4, 1)), delay="1 day"), "odd").orderBy("event_id").collect()
    assert [(r.event_id, r.bar, r.ret_1, r.vwap_distance) for r in got] == [(2, 1, None, None), (3, 2, -1.0, None)]


def test_replay_goes_on_where_it_stopped(spark):
    t, folder = ticks(spark, 5), scratch(spark, "replay")
    write_days(t.withColumn("day", F.to_date("ts").cast("string")), f"{folder}/table", "day", ["ts", "event_id"])

    def days_of_batches(until=None):
        seen = []
        s = replayed(spark, f"{folder}/table", "day", t.schema, f"{folder}/checkpoint", until)
        q = s.writeStream.foreachBatch(lambda b, n: seen.append(sorted({str(r.ts)[:10] for r in b.collect()}))).option("checkpointLocation", f"{folder}/checkpoint").start()
        q.processAllAvailable()
        q.stop()
        return [x for x in seen if x]

    assert days_of_batches("2024-03-02") == [["2024-03-01"], ["2024-03-02"]]
    assert days_of_batches() == [["2024-03-04"]]
    assert days_of_batches() == []
    reader = DayReader({"path": f"{folder}/table", "day": "day", "checkpoint": f"{folder}/none", "closing": "0", "ts": "ts"}, t.schema)
    assert [reader.latestOffset()["day"] for _ in range(5)][-2:] == [END, END] and len(reader.partitions({"day": ""}, {"day": END})) == 4


def test_an_empty_table_replays_to_nothing(spark):
    empty = ticks(spark, 1).limit(0)
    rows, delay = SQ.shuffled_files(empty, 2)
    assert ST.run_to_table(EV.session_features(rows, delay=delay), "empty").count() == 0


def test_waiting_rows_are_packed_by_the_hour(spark):
    """State has an entry for each hour of a key, not for each row, so that no task holds all rows that wait."""
    t, folder = ticks(spark), scratch(spark, "packed")
    s = as_stream(spark, [t])
    rows = ST.run_to_table(EV.morning_summary(s, 600, 690, delay="10 days"), "packed", folder=folder)
    waiting = EV.open_state(spark, f"{folder}/checkpoint", "waiting")
    hours = t.select("instrument", F.date_trunc("hour", "ts")).distinct().count()
    assert rows.count() == 0 and waiting.count() == hours == 2 * 3 * 7 and hours < t.count()
