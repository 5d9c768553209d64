"""The given tables as bars, chains, trades and scores; each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chain import aggregate_minute, pivoted
from ..operators.evaluate import ohlcv

KEYS = ["session", "instrument"]
ORDER = ["ts", "event_id"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of events: a session is a day, an instrument an event type."""
    e = read(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("session"), F.col("event_type").alias("instrument"), "ts", "event_id", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("int").alias("volume"), "user_id")


BARS = """bars AS (SELECT CAST(ts AS DATE) AS session, event_type AS instrument, ts, event_id, value AS price,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS volume, user_id FROM events)"""
NUMBERED = BARS + ", b AS (SELECT *, row_number() OVER (PARTITION BY session, instrument ORDER BY ts, event_id) AS rn FROM bars)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar for each hour that has ticks; minute counts hours of the day."""
    b = bars(spark, sf_dir)
    o = ohlcv(b, KEYS, F.hour("ts"), ORDER)
    return o.withColumnRenamed("bucket", "hr")


HOURLY = BARS + """, hourly AS (SELECT session, instrument, hour(ts)::INTEGER AS hr, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, event_id) AS close, sum(volume)::BIGINT AS volume, count(*) AS n FROM bars GROUP BY ALL)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ohlcv(bars(spark, sf_dir), ["instrument"], "session", ORDER)
    return d.withColumnRenamed("bucket", "session")


DAILY = BARS + """, daily AS (SELECT instrument, session, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, event_id) AS close, sum(volume)::BIGINT AS volume, count(*) AS n FROM bars GROUP BY ALL)"""


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", "CE").otherwise("PE")
    return li.select(
        F.date_trunc("month", "l_shipdate").cast("date").alias("ts"), (F.col("l_partkey") % 41).cast("int").alias("strike"), side.alias("side"), F.col("l_extendedprice").alias("ltp"), F.col("l_quantity").alias("oi"), F.col("l_linenumber").cast("double").alias("volume"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


CHAIN_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ltp", "oi"]


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_minute(chain_rows(spark, sf_dir), ["ts"], CHAIN_ORDER)


CHAIN = """rows_ AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, (l_partkey % 41)::INTEGER AS strike, CASE WHEN l_returnflag = 'R' THEN 'CE' ELSE 'PE' END AS side,
  l_extendedprice AS ltp, l_quantity AS oi, l_linenumber::DOUBLE AS volume, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
chain AS (SELECT ts, strike, side, last(ltp ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, ltp, oi) AS ltp,
  first(ltp ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, ltp, oi) AS open, max(ltp) AS high, min(ltp) AS low, sum(oi) AS oi, sum(volume) AS volume FROM rows_ GROUP BY ALL)"""


def wide_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivoted(chain(spark, sf_dir), ["ts"])


WIDE = CHAIN + """, wide AS (SELECT ts, strike, max(ltp) FILTER (side = 'CE') AS ce_ltp, coalesce(max(oi) FILTER (side = 'CE'), 0) AS ce_oi, coalesce(max(volume) FILTER (side = 'CE'), 0) AS ce_volume,
  max(ltp) FILTER (side = 'PE') AS pe_ltp, coalesce(max(oi) FILTER (side = 'PE'), 0) AS pe_oi, coalesce(max(volume) FILTER (side = 'PE'), 0) AS pe_volume FROM chain GROUP BY ts, strike)"""


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price for each chain: the mean strike of its open interest."""
    w = wide_chain(spark, sf_dir)
    oi = F.col("ce_oi") + F.col("pe_oi")
    return w.groupBy("ts").agg(F.round(F.sum(F.col("strike") * oi) / F.sum(oi), 3).alias("spot"))


SPOTS = WIDE + ", spots AS (SELECT ts, round(sum(strike * (ce_oi + pe_oi)) / sum(ce_oi + pe_oi), 3) AS spot FROM wide GROUP BY ts)"
ATM = SPOTS + """, atm AS (SELECT ts, strike AS atm_strike, spot, ce_ltp + pe_ltp AS straddle FROM (
  SELECT w.*, s.spot, row_number() OVER (PARTITION BY ts ORDER BY abs(strike - spot), strike) AS k FROM wide w JOIN spots s USING (ts)) WHERE k = 1)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    ret = F.round(F.avg(F.col("l_discount").cast("decimal(9,4)") - F.col("l_tax").cast("decimal(9,4)")).cast("double"), 6)
    g = li.groupBy("l_orderkey").agg(ret.alias("ret"), F.max("l_returnflag").alias("exit_reason"), F.min("l_linestatus").alias("side"), F.max("l_quantity").alias("bars_held"), F.round(F.max("l_discount"), 6).alias("mfe"), F.round(-F.max("l_tax"), 6).alias("mae"))
    return o.join(g, o.o_orderkey == g.l_orderkey).select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("regime"), "ret", "exit_reason", "side", "bars_held", "mfe", "mae", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))


TRADES = """trades AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS regime, ret, exit_reason, side, bars_held, mfe, mae, o_totalprice AS price, o_custkey AS cust
  FROM orders JOIN (SELECT l_orderkey, round(avg(round(l_discount - l_tax, 4)), 6) + 0 AS ret, max(l_returnflag) AS exit_reason, min(l_linestatus) AS side, max(l_quantity) AS bars_held,
    round(max(l_discount), 6) AS mfe, round(-max(l_tax), 6) + 0 AS mae FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents with their labels: y, a score p in [0, 1] and columns to group by."""
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", "lang", "source", "n_chars", F.col("quality").alias("y"), F.col("toxic").alias("z"), F.round(F.pmod(F.col("n_chars"), F.lit(1009)) / 1009, 4).alias("p"))


SCORES = "scores AS (SELECT doc_id, lang, source, n_chars, quality AS y, toxic AS z, round((n_chars % 1009) / 1009, 4) AS p FROM documents JOIN labels USING (doc_id))"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position events: an id is a user's day, the event a fixed map of the event types."""
    b = bars(spark, sf_dir)
    kinds = F.create_map(*(F.lit(x) for kv in POSITION_EVENTS.items() for x in kv))
    return b.withColumn("event", kinds[F.col("instrument")]).withColumn("id", F.concat_ws("-", "user_id", F.date_format("session", "yyyyMMdd"))).where("event is not null")


POSITION_EVENTS = {"view": "OPEN", "signup": "OPEN", "click": "MANAGE", "error": "MANAGE", "purchase": "CLOSE"}
POSITIONS = BARS + ", pos AS (SELECT *, user_id || '-' || strftime(session, '%Y%m%d') AS id, CASE instrument " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POSITION_EVENTS.items()) + " END AS event FROM bars WHERE instrument IN ('" + "','".join(POSITION_EVENTS) + "'))"
