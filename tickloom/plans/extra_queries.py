"""Queries of sources, sinks, functions, checks and reports that the other modules don't have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import chain as CH
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import quality as Q
from ..operators import scans as C
from ..operators import windows as W
from ..sources import readers, writers
from ..streaming import jobs as ST
from .catalogue import query, rounded
from .views import BARS, CHAIN, DAILY, HOURLY, KEYS, NUMBERED, ORDER, SCORES, TRADES, WIDE, bars, chain, daily, hourly, read, scores, trades, wide_chain

# ---------------------------------------------------------------- sources and sinks


@query("src_1_3_csv_folders", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS o_custkey FROM orders")
def csv_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders go to CSV folders, whose open orders have a column more, and come back as one table."""
    o = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_orderpriority", "o_custkey", "o_orderstatus")
    root = writers.scratch(spark, "csv")
    o.where("o_orderstatus = 'O'").select("o_orderkey", "y", "o_orderpriority", "o_custkey").write.option("header", True).csv(f"{root}/open/deep")
    o.where("o_orderstatus <> 'O'").select("o_orderkey", "y", "o_orderpriority").write.option("header", True).csv(f"{root}/closed")
    parts = [readers.csv_folder(spark, f"{root}/open", "o_orderkey long, y int, o_orderpriority string, o_custkey long", "*.csv", recursive=True), readers.csv_folder(spark, f"{root}/closed", "o_orderkey long, y int, o_orderpriority string")]
    return readers.union_by_name(parts)


@query("src_2_path_dates", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month FROM orders")
def path_dates(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch(spark, "months")
    o = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    o.repartition("year", "month").write.partitionBy("year", "month").parquet(root)
    raw = spark.read.schema("o_orderkey long").option("recursiveFileLookup", True).parquet(root)
    return readers.with_path_dates(raw)


@query("src_9_feature_table", "SELECT event_id, CAST(ts AS DATE) AS trade_date FROM events")
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return readers.feature_table(read(spark, sf, "events").withColumnRenamed("ts", "timestamp")).select("event_id", "trade_date")


@query("src_10_json_lines", "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE event_type <> 'error'")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of JSON; those of errors are cut in half on the way and left out when read."""
    whole = F.to_json(F.struct("event_id", "user_id", "value"))
    e = read(spark, sf, "events").select(F.when(F.col("event_type") == "error", F.substring(whole, 1, 9)).otherwise(whole).alias("value"))
    path = writers.scratch(spark, "lines")
    e.write.text(path)
    return rounded(readers.jsonl(spark, path, "event_id long, user_id long, value double"))


@query("src_12_range_of_stored_rows", "WITH " + BARS + " SELECT event_id, ts FROM bars WHERE session BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def stored_range(spark: SparkSession, sf: str) -> DataFrame:
    """A range of days of a table of one folder a day, with two of its columns."""
    root = writers.scratch(spark, "stored")
    writers.write_days(bars(spark, sf), root, "session", ["ts"])
    return readers.date_range(readers.parquet_dataset(spark, root, "ts"), "session", "2024-01-05", "2024-01-20", ["event_id", "ts"])


@query("src_14_tables_by_suffix", "SELECT c_custkey, c_mktsegment, 'csv' AS kind FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'tsv' FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'parquet' FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'json' FROM customer")
def tables_by_suffix(spark: SparkSession, sf: str) -> DataFrame:
    c, root, out = read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), writers.scratch(spark, "suffix"), None
    c.write.option("header", True).csv(f"{root}/a.csv")
    c.write.option("header", True).option("sep", "\t").csv(f"{root}/a.tsv")
    c.write.parquet(f"{root}/a.parquet")
    c.write.json(f"{root}/a.json")
    for kind in ("csv", "tsv", "parquet", "json"):
        part = readers.table(spark, f"{root}/a.{kind}").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("snk_6_retained_days", "WITH " + TRADES + " SELECT id, day FROM trades WHERE day >= (SELECT max(day) FROM trades) - 365")
def retained(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).select("id", "day")
    last = t.agg(F.max("day").alias("last"))  # one row
    return writers.retained(t.crossJoin(last), "day", 365, F.col("last")).select("id", "day")


@query("snk_8_messages", "SELECT user_id::VARCHAR AS key, event_id, event_type, 'run-1' AS run_id, 'historical' AS mode FROM events")
def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON messages with a run and a mode, and read again."""
    sent = writers.as_messages(read(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", run_id="run-1", mode="historical")
    got = F.from_json("value", "event_id long, event_type string, run_id string, mode string").alias("m")
    return sent.select("key", got).select("key", "m.*")


@query("set_1_union_by_name", "SELECT o_orderkey AS id, o_totalprice AS price, NULL::INTEGER AS size FROM orders UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = read(spark, sf, "part").select(F.col("p_size").alias("size"), F.col("p_partkey").alias("id"))
    return readers.union_by_name([a, b])


# ---------------------------------------------------------------- projections and functions


@query("prj_12_13_feature_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem")
def feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The numeric columns that patterns include, but for what leaks the outcome."""
    li = read(spark, sf, "lineitem").withColumn("future_price", F.col("l_extendedprice"))
    numeric = S.numeric_features(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    kept = [c for c in S.select_by_pattern(li, [r"l_.*", r"future_.*"], [r".*tax"]) if c in numeric]
    return li.select("l_orderkey", "l_linenumber", *kept)


@query(
    "fun_6_7_expiries",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 336 MONTH AS DATE) AS day, o_orderkey % 4 AS k FROM orders), x AS (SELECT *, CASE WHEN k = 3 THEN day + ((11 - isodow(day)) % 7)::INTEGER ELSE day + (o_orderkey % 40)::INTEGER - 5 END AS expiry FROM o)
SELECT o_orderkey, expiry, greatest(0, expiry - day)::INTEGER AS dte, round(greatest(60, epoch(expiry::TIMESTAMP) + 930 * 60 - epoch(day::TIMESTAMP)) / 31536000.0, 8) AS years FROM x""",
)
def expiries(spark: SparkSession, sf: str) -> DataFrame:
    """Expiries near each order's day, 28 years on, in the three forms and one that is none."""
    o = read(spark, sf, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 336).alias("day"), (F.col("o_orderkey") % 4).alias("k"))
    e = F.date_add("day", (F.col("o_orderkey") % 40).cast("int") - 5)
    text = F.when(F.col("k") == 0, F.date_format(e, "yyyy-MM-dd")).when(F.col("k") == 1, F.upper(F.date_format(e, "ddMMMyy"))).when(F.col("k") == 2, F.date_format(e, "yyyyMMdd")).otherwise("none")
    x = o.withColumn("expiry", S.parse_expiry(text, "day"))
    return x.select("o_orderkey", "expiry", S.days_to_expiry("expiry", "day").cast("int").alias("dte"), F.round(S.years_to_expiry("expiry", "day"), 8).alias("years"))


@query("fun_8_zones", "SELECT event_id, ts + INTERVAL 330 MINUTE AS local_ts FROM events")
def zones(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", S.to_zone("ts", "UTC").alias("local_ts"))


@query(
    "fun_11_12_volatility_and_rates",
    """SELECT p_partkey, round(CASE WHEN iv > 3 THEN iv / 100 WHEN iv > 0 THEN iv END, 6) AS iv, CASE WHEN skew > 0.005 THEN 'PUT_FEAR' WHEN skew < -0.005 THEN 'CALL_FEAR' ELSE 'NEUTRAL' END AS skew,
CASE WHEN d >= DATE '2024-03-01' THEN 0.065 WHEN d >= DATE '2024-02-01' THEN 0.06 ELSE 0.05 END AS rate FROM (SELECT p_partkey, (p_size - 4)::DOUBLE AS iv, (p_size % 7 - 3) / 300.0::DOUBLE AS skew, DATE '2024-01-01' + p_size * 2 AS d FROM part)""",
)
def volatility_and_rates(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select("p_partkey", (F.col("p_size") - 4).cast("double").alias("iv"), ((F.col("p_size") % 7 - 3) / 300.0).alias("skew"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") * 2).alias("d"))
    return p.select("p_partkey", F.round(S.normal_iv("iv"), 6).alias("iv"), S.skew_label("skew").alias("skew"), S.step_rate("d", [("2020-01-01", 0.05), ("2024-02-01", 0.06), ("2024-03-01", 0.065)]).alias("rate"))


_D1 = "(ln(spot / strike) + (0.06 + vol * vol / 2) * 0.25) / (vol * 0.5)"


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    upper = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * ((((1.330274429 * {t} - 1.821255978) * {t} + 1.781477937) * {t} - 0.356563782) * {t} + 0.319381530) * {t})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END)"


@query(
    "fun_13_option_values",
    f"""WITH p AS (SELECT p_partkey, p_retailprice AS spot, 800 + p_size * 10.0::DOUBLE AS strike, 0.1 + p_size / 100::DOUBLE AS vol, p_partkey % 2 = 0 AS is_call FROM part), d AS (SELECT *, {_D1} AS d1, {_D1} - vol * 0.5 AS d2, strike * exp(-0.06 * 0.25) AS paid FROM p)
SELECT p_partkey, round(CASE WHEN is_call THEN spot * {_cdf('d1')} - paid * {_cdf('d2')} ELSE paid * {_cdf('-d2')} - spot * {_cdf('-d1')} END, 4) AS value, round(CASE WHEN is_call THEN {_cdf('d1')} ELSE {_cdf('d1')} - 1 END, 6) AS delta,
round(exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot * vol * 0.5), 6) AS gamma, round(spot * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * 0.5 / 100, 6) AS vega, true AS solved FROM d""",
)
def black_scholes(spark: SparkSession, sf: str) -> DataFrame:
    """Values and greeks, and whether the volatility solved from a value gives that value again."""
    strike, vol, call, years, rate = 800 + F.col("p_size") * 10.0, 0.1 + F.col("p_size") / 100, F.col("p_partkey") % 2 == 0, F.lit(0.25), F.lit(0.06)
    x = read(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("spot"), strike.alias("strike"), vol.alias("vol"), call.alias("call"))
    again = lambda v: S.option_value(F.col("spot"), F.col("strike"), years, rate, v, F.col("call"))
    x = x.withColumn("value", again(F.col("vol"))).withColumn("iv", S.implied_vol(F.col("value"), F.col("spot"), F.col("strike"), years, rate, F.col("call")))
    x = x.withColumn("solved", F.coalesce(F.abs(again(F.col("iv")) - F.col("value")) < 1e-3, F.col("value") < 0.05)).withColumn("g", S.greeks(F.col("spot"), F.col("strike"), years, rate, F.col("vol"), F.col("call")))
    return x.select("p_partkey", F.round("value", 4).alias("value"), *(F.round(f"g.{c}", 6).alias(c) for c in ("delta", "gamma", "vega")), "solved")


@query("fun_16_print_sides", "WITH " + BARS + ", m AS (SELECT *, (max(price) OVER w + min(price) OVER w) / 2 AS mid FROM bars WINDOW w AS (PARTITION BY session, instrument)) SELECT event_id, CASE WHEN price >= mid THEN 'BUY' WHEN price < mid THEN 'SELL' END AS side FROM m")
def print_sides(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy(*KEYS)
    b = bars(spark, sf).withColumn("mid", (F.max("price").over(w) + F.min("price").over(w)) / 2)
    return b.select("event_id", S.print_side("price", "mid").alias("side"))


@query("fun_17_label_maps", "WITH " + TRADES + ", r AS (SELECT *, CASE exit_reason WHEN 'R' THEN 'tp' WHEN 'A' THEN 'sl' ELSE 'time' END AS reason FROM trades) SELECT id, CASE reason WHEN 'tp' THEN 1 WHEN 'sl' THEN 0 END AS label, CASE WHEN ret > 0 THEN 'WIN' WHEN ret < 0 THEN 'LOSS' ELSE 'FLAT' END AS result FROM r")
def label_maps(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.when(F.col("exit_reason") == "R", "tp").when(F.col("exit_reason") == "A", "sl").otherwise("time")
    return trades(spark, sf).select("id", S.path_label(reason).alias("label"), S.result_label("ret").alias("result"))


# ---------------------------------------------------------------- windows, sorts, chains and labels


@query("win_28_29_row_index_and_sums", "WITH " + NUMBERED + " SELECT event_id, (rn - 1)::INTEGER AS row_index, sum(volume) OVER (PARTITION BY session, instrument ORDER BY ts, event_id ROWS 4 PRECEDING)::BIGINT AS volume_5 FROM b")
def row_index(spark: SparkSession, sf: str) -> DataFrame:
    w = W.over(KEYS, ORDER)
    return bars(spark, sf).select("event_id", (F.row_number().over(w) - 1).alias("row_index"), W.rolling(F.sum, "volume", 5, 1, w).alias("volume_5"))


@query("srt_1_mixed_order", "WITH " + TRADES + " SELECT id, side, round(ret, 6) AS ret, row_number() OVER (PARTITION BY day ORDER BY side, ret DESC, id)::INTEGER AS place FROM trades")
def mixed_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each day by side upwards, return downwards, id."""
    return rounded(trades(spark, sf).withColumn("place", F.row_number().over(W.over(["day"], ["side", F.desc("ret"), "id"]))), "id", "side", "ret", "place")


@query("agg_8_days_with_data", "WITH " + BARS + " SELECT session, count(*) FILTER (instrument = 'purchase' AND price > 100) > 0 AS has_large, count(*) FILTER (volume IS NULL) > 0 AS has_gaps FROM bars GROUP BY session")
def days_with_data(spark: SparkSession, sf: str) -> DataFrame:
    """Existence per day as an aggregate; exists() is the same for a whole table, and stops at its first row."""
    return bars(spark, sf).groupBy("session").agg(F.coalesce(F.bool_or((F.col("instrument") == "purchase") & (F.col("price") > 100)), F.lit(False)).alias("has_large"), F.bool_or(F.col("volume").isNull()).alias("has_gaps"))


@query("chn_9_otm_strikes", "WITH " + CHAIN + " SELECT ts, strike, side, (strike + CASE WHEN side = 'CE' THEN 2 ELSE -2 END * 5)::DOUBLE AS otm FROM chain")
def otm_strikes(spark: SparkSession, sf: str) -> DataFrame:
    return chain(spark, sf).select("ts", "strike", "side", CH.otm_strike(F.col("strike"), F.col("side"), 2, 5).cast("double").alias("otm"))


@query(
    "chn_10_held_paths",
    "WITH " + CHAIN + """, m AS (SELECT *, (year(ts) * 12 + month(ts))::INTEGER AS month_no FROM chain), e AS (SELECT strike, side, month_no AS entry_month FROM m), s AS (SELECT *, unnest(range(entry_month + 1, entry_month + 5))::INTEGER AS month_no FROM e),
j AS (SELECT s.*, m.ltp FROM s LEFT JOIN m USING (strike, side, month_no)) SELECT strike, side, entry_month, month_no, round(last_value(ltp IGNORE NULLS) OVER (PARTITION BY strike, side, entry_month ORDER BY month_no ROWS UNBOUNDED PRECEDING), 6) AS path_price FROM j""",
)
def held_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The contract of every row followed through the next four months."""
    m = chain(spark, sf).select((F.year("ts") * 12 + F.month("ts")).alias("month_no"), "strike", "side", "ltp")
    entries = m.select(F.concat_ws("/", "month_no", "strike", "side").alias("id"), "strike", "side", F.col("month_no").alias("entry_ts"))
    out = CH.held_paths(entries, m, ["strike", "side"], "month_no", 4)
    return rounded(out.withColumnRenamed("entry_ts", "entry_month"), "strike", "side", "entry_month", "month_no", "path_price")


@query("chn_11_atm_iv", "WITH " + WIDE + ", v AS (SELECT ts, strike, ce_ltp / 100000 AS ce, pe_ltp / 100000 AS pe FROM wide) SELECT ts, strike, round(coalesce((ce + pe) / 2, ce, pe), 4) AS iv, round(pe - ce, 4) AS skew FROM v")
def atm_iv(spark: SparkSession, sf: str) -> DataFrame:
    w = wide_chain(spark, sf).select("ts", "strike", CH.atm_iv(F.col("ce_ltp") / 100000, F.col("pe_ltp") / 100000).alias("x"))
    return w.select("ts", "strike", F.round("x.iv", 4).alias("iv"), F.round("x.skew", 4).alias("skew"))


@query("lbl_3_best_side", "WITH " + HOURLY + ", r AS (SELECT session, instrument, hr, lead(close) OVER (PARTITION BY session, instrument ORDER BY hr) - close AS up FROM hourly), s AS (SELECT *, up - 1 AS a, -up - 1 AS b FROM r) SELECT session, instrument, hr, CASE WHEN a > 0 AND a >= coalesce(b, a) THEN 'CE' WHEN b > 0 THEN 'PE' END AS side FROM s")
def best_side(spark: SparkSession, sf: str) -> DataFrame:
    up = F.lead("close").over(W.over(KEYS, ["hr"])) - F.col("close")
    h = hourly(spark, sf).withColumn("up", up).withColumns({"a": F.col("up") - 1, "b": -F.col("up") - 1})
    return h.select(*KEYS, "hr", L.best_side("a", "b").alias("side"))


@query("lbl_2_barrier_widths", "WITH " + HOURLY + " SELECT session, instrument, hr, round(greatest(0.005, least(0.02, 0.5 * (high - low) / close)), 6) AS width FROM hourly WHERE close > 0")
def barrier_widths(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf).where("close > 0").withColumn("atr", F.col("high") - F.col("low"))
    return rounded(h.withColumn("width", L.barrier_width(0.01, "atr", 0.5, 0.5, 2.0, "close")), *KEYS, "hr", "width")


@query("lbl_15_counterfactual", "WITH " + TRADES + ", k AS (SELECT l_orderkey AS id, max(l_discount - l_tax) FILTER (l_linenumber = 2) AS at_2 FROM lineitem GROUP BY 1) SELECT id, round(CASE WHEN mae <= -0.06 AND at_2 IS NOT NULL THEN at_2 ELSE ret END, 6) AS outcome FROM trades JOIN k USING (id)")
def counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    k = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.when(F.col("l_linenumber") == 2, F.col("l_discount") - F.col("l_tax"))).alias("at_2"))
    t = trades(spark, sf).join(k, "id")
    return rounded(t.withColumn("outcome", L.counterfactual(t, F.col("mae") <= -0.06, "ret", "at_2")), "id", "outcome")


# ---------------------------------------------------------------- evaluation


@query("evl_1_profit_factor", "WITH " + TRADES + ", m AS (SELECT day, round(ret * 1000000)::BIGINT AS r FROM trades) SELECT day, round(coalesce(sum(r) FILTER (r > 0), 0)::DOUBLE / nullif(-sum(r) FILTER (r < 0), 0), 6) AS profit_factor FROM m GROUP BY day")
def profit_factor(spark: SparkSession, sf: str) -> DataFrame:
    """Returns in whole millionths, so that sums are exact."""
    t = trades(spark, sf).select("day", F.round(F.col("ret") * 1000000).cast("long").alias("r"))
    return rounded(t.groupBy("day").agg(E.profit_factor("r").cast("double").alias("profit_factor")))


@query(
    "evl_2_summary_with_drawdown",
    "WITH " + TRADES + ", e AS (SELECT regime, id, day, ret, sum(ret) OVER (PARTITION BY regime ORDER BY day, id) AS q FROM trades), p AS (SELECT *, greatest(0, max(q) OVER (PARTITION BY regime ORDER BY day, id)) AS top FROM e), d AS (SELECT regime, round(-min(q - top), 5) AS max_drawdown FROM p GROUP BY 1)"
    " SELECT t.regime, count(*) AS trades, round(avg((side = 'O')::INT), 6) AS long_share, any_value(max_drawdown) AS max_drawdown FROM trades t JOIN d USING (regime) GROUP BY t.regime",
)
def summary_with_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).withColumn("side", F.when(F.col("side") == "O", "CE").otherwise("PE"))
    s = E.return_summary(t, ["regime"], "ret", F.col("ret").isNotNull(), "side")
    d = C.max_drawdown(t, "ret", ["regime"], ["day", "id"], capital=0.0)
    return s.join(d, "regime").select("regime", "trades", F.round("long_share", 6).alias("long_share"), F.round("max_drawdown", 5).alias("max_drawdown"))



def _weights_sql(units: str, unit: str, iterations: int) -> str:
    import math

    cuts, p, tail, k = [], math.exp(-1), 0.0, 0
    while tail < 1 - 1e-9:
        tail += p
        cuts.append(repr(tail))
        k += 1
        p /= k
    hit = " + ".join(f"(u >= {c})::INT" for c in cuts)
    return f"""its AS (SELECT unnest(range(1, {iterations + 1})) AS it), us AS ({units}), hs AS (SELECT {unit}, it, ('0x' || left(md5('3:' || {unit}::VARCHAR || ':' || it::VARCHAR), 7))::BIGINT / 268435456.0::DOUBLE AS u FROM us, its), ws AS (SELECT {unit}, it, {hit} AS w FROM hs)"""


@query(
    "evl_12_set_8_bootstrap",
    "WITH " + TRADES + ", " + _weights_sql("SELECT day, sum(ret) AS s, count(ret) AS n FROM trades GROUP BY day", "day", 200) + ", m AS (SELECT it, sum(w * s) / nullif(sum(w * n), 0) AS m FROM ws JOIN us USING (day) WHERE w > 0 GROUP BY it) SELECT count(m) AS iterations, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m",
)
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """200 resamples of whole days."""
    return rounded(E.bootstrap_mean(trades(spark, sf), "day", "ret"))


@query(
    "evl_12_profit_factor_interval",
    "WITH " + TRADES + ", " + _weights_sql("SELECT day, coalesce(sum(ret) FILTER (ret > 0), 0) AS g, coalesce(-sum(ret) FILTER (ret < 0), 0) AS l FROM trades GROUP BY day", "day", 200) + ", m AS (SELECT it, sum(w * g) / nullif(sum(w * l), 0) AS m FROM ws JOIN us USING (day) WHERE w > 0 GROUP BY it) SELECT count(m) AS iterations, round(avg(m), 5) AS mean, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high FROM m",
)
def profit_factor_interval(spark: SparkSession, sf: str) -> DataFrame:
    x = E.bootstrap_profit_factor(trades(spark, sf), "day", "ret")
    return x.select("iterations", *(F.round(c, 5).alias(c) for c in ("mean", "low", "high")))


@query(
    "evl_12_auc_interval",
    "WITH " + SCORES + ", " + _weights_sql("SELECT DISTINCT source FROM scores WHERE p IS NOT NULL AND y IS NOT NULL AND source IS NOT NULL", "source", 40) + """, g AS (SELECT it, p, sum(w) AS n, sum(w * y) AS pos, sum(w * (y - p) * (y - p)) AS b FROM ws JOIN scores USING (source) WHERE w > 0 AND y IS NOT NULL AND p IS NOT NULL GROUP BY it, p),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY it ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM g), s AS (SELECT it, sum(n) AS n, sum(pos) AS pos, sum(rank * pos) AS r, sum(b) AS b FROM r GROUP BY it),
m AS (SELECT 'auc' AS measure, (r - pos * (pos + 1) / 2) / nullif(pos * (n - pos), 0) AS m FROM s UNION ALL SELECT 'brier', b / nullif(n, 0) FROM s) SELECT measure, count(m) AS iterations, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY measure""",
)
def auc_interval(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.bootstrap_auc(scores(spark, sf).where("source is not null"), "source", "p", "y", 40))


@query(
    "evl_3_half_drift",
    "WITH " + SCORES + """, h AS (SELECT *, (doc_id >= (SELECT quantile_disc(doc_id, 0.5) FROM scores))::INT AS half FROM scores WHERE y IS NOT NULL AND p IS NOT NULL), g AS (SELECT half, p, count(*) AS n, sum(y) AS pos, sum((y - p) * (y - p)) AS b FROM h GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY half ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM g), s AS (SELECT half, sum(b) / sum(n) AS brier, (sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (sum(n) - sum(pos)), 0) AS auc FROM r GROUP BY half)
SELECT round(max(auc) FILTER (half = 0), 6) AS auc_first, round(max(auc) FILTER (half = 1), 6) AS auc_second, round(max(brier) FILTER (half = 0), 6) AS brier_first, round(max(brier) FILTER (half = 1), 6) AS brier_second,
round(max(auc) FILTER (half = 1) - max(auc) FILTER (half = 0), 6) AS auc_drift, round(max(brier) FILTER (half = 1) - max(brier) FILTER (half = 0), 6) AS brier_drift FROM s""",
)
def half_drift(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf)
    middle = s.agg(F.expr("percentile_disc(0.5) within group (order by doc_id)").alias("middle"))  # one row
    return rounded(E.half_drift(s.crossJoin(middle), "p", "y", (F.col("doc_id") >= F.col("middle")).cast("int")))


@query(
    "evl_14_separation_stability",
    "WITH " + SCORES + """, f AS (SELECT source, y, 'p' AS feature, p AS v FROM scores UNION ALL SELECT source, y, 'n_chars', n_chars FROM scores), w AS (SELECT feature, source, (avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / nullif(sqrt((var_pop(v) FILTER (y = 1) + var_pop(v) FILTER (y = 0)) / 2), 0) AS d FROM f WHERE v IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, avg(d) OVER (PARTITION BY feature) AS m FROM w WHERE d IS NOT NULL) SELECT feature, count(*) AS windows, round(avg(d), 5) AS mean_d, round(stddev_pop(d), 5) AS spread_d, round(avg((sign(d) = sign(m))::INT), 5) AS sign_share, round(arg_max(d, source) - arg_min(d, source), 5) AS drift_d FROM x GROUP BY feature""",
)
def separation_stability(spark: SparkSession, sf: str) -> DataFrame:
    x = E.separation_stability(scores(spark, sf), ["p", "n_chars"], "y", "source")
    return x.select("feature", "windows", *(F.round(c, 5).alias(c) for c in ("mean_d", "spread_d", "sign_share", "drift_d")))


@query("evl_21_capital_metrics", "SELECT l_orderkey, l_linenumber, round(e * q, 4) AS at_risk, round((x - e) * q, 4) AS pnl_amount, round((x - e) * q / 100000, 9) AS capital_share, round(CASE WHEN mfe > 0 THEN (x / e - 1) / mfe END, 6) AS capture FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS e, l_extendedprice * (1 + l_discount - l_tax) AS x, l_quantity AS q, l_discount AS mfe FROM lineitem)")
def capital_metrics(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").withColumn("exit", F.col("l_extendedprice") * (1 + F.col("l_discount") - F.col("l_tax")))
    x = E.capital_metrics(li, "l_extendedprice", "exit", "l_quantity", "l_discount", 100000.0)
    return x.select("l_orderkey", "l_linenumber", F.round("at_risk", 4).alias("at_risk"), F.round("pnl_amount", 4).alias("pnl_amount"), F.round("capital_share", 9).alias("capital_share"), F.round("capture", 6).alias("capture"))


# ---------------------------------------------------------------- quality


@query("dqc_1_schema_problems", "SELECT 'events' AS name, count(*) AS rows, 'forbidden props,missing strike' AS problems FROM events UNION ALL SELECT 'orders', count(*), 'missing strike' FROM orders UNION ALL SELECT 'lineitem', count(*), 'missing strike' FROM lineitem")
def schema_problems(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the columns of three tables against a contract that wants a strike and no props, with their rows."""
    out = None
    for name in ("events", "orders", "lineitem"):
        t = read(spark, sf, name)
        found = ",".join(sorted(Q.schema_problems(t, ["strike"], ["props"])))
        part = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(found).alias("problems"))
        out = part if out is None else out.unionByName(part)
    return out


@query("dqc_12_readiness", "WITH " + BARS + " SELECT instrument, count(*) AS rows, count(DISTINCT session) AS days, count(*) >= 150 AS enough_rows, count(DISTINCT session) >= 20 AS enough_days, count(*) >= 150 AND count(DISTINCT session) >= 20 AS ready FROM bars GROUP BY 1")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    per = bars(spark, sf).groupBy("instrument").agg(F.count("*").alias("rows"), F.count_distinct("session").alias("days"))
    return Q.readiness(per, 150, 20)


@query("dqc_13_diagnostics", "WITH " + CHAIN + " SELECT side, count(*) AS rows, count(*) FILTER (ltp > 90000) AS dear, count(*) FILTER (oi = 0) AS empty, count(*) FILTER (open = ltp) AS unchanged FROM chain GROUP BY side")
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return Q.diagnostics(chain(spark, sf), ["side"], {"dear": F.col("ltp") > 90000, "empty": F.col("oi") == 0, "unchanged": F.col("open") == F.col("ltp")})


@query("dqc_14_label_sanity", "WITH " + TRADES + ", x AS (SELECT dayofweek(day)::INTEGER AS weekday, (ret > 0)::INT AS y, price, CASE WHEN exit_reason = 'N' THEN 'late' END AS skip FROM trades) SELECT weekday, count(*) AS rows, round(avg(y), 6) AS positive_rate, round(avg(price), 4) AS mean_premium, round(avg((skip IS NOT NULL)::INT), 6) AS skip_rate, avg(y) BETWEEN 0.4 AND 0.6 AND avg((skip IS NOT NULL)::INT) <= 0.7 AS ok FROM x GROUP BY weekday")
def label_sanity(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).withColumns({"weekday": F.dayofweek("day") - 1, "y": (F.col("ret") > 0).cast("int"), "skip": F.when(F.col("exit_reason") == "N", "late")})
    g = Q.label_sanity(t, ["weekday"], "y", "price", "skip", 0.4, 0.6, 0.7)
    return g.select("weekday", "rows", F.round("positive_rate", 6).alias("positive_rate"), F.round("mean_premium", 4).alias("mean_premium"), F.round("skip_rate", 6).alias("skip_rate"), "ok")


@query(
    "dqc_15_structure_errors",
    "WITH g AS (SELECT l_orderkey, max(l_shipdate) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount = 0) AS without FROM lineitem GROUP BY 1) SELECT l_orderkey, concat_ws(',', CASE WHEN returned IS NULL THEN 'head.returned is missing' END, CASE WHEN without > 0 THEN 'lines has items without discount' END) AS errors FROM g",
)
def structure_errors(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct("l_linenumber", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"))
    g = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("returned"), F.collect_list(item).alias("lines"))
    nested = g.select("l_orderkey", F.struct("returned").alias("head"), "lines")
    return nested.select("l_orderkey", F.array_join(Q.structure_errors(nested, ["head.returned"], {"lines": ["l_linenumber", "discount"]}), ",").alias("errors"))


@query("dqc_16_fill_rates", "WITH " + BARS + " SELECT session, count(*) AS rows, count(price) AS n_price, count(volume) AS n_volume, 0::BIGINT AS n_strike FROM bars WHERE session BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY session")
def fill_rates(spark: SparkSession, sf: str) -> DataFrame:
    b = readers.date_range(bars(spark, sf), "session", "2024-01-03", "2024-01-25")
    return E.field_coverage(b, ["session"], ["price", "volume", "strike"])


# ---------------------------------------------------------------- streams


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return readers.stream(spark, f"{sf}/events*.parquet", spark.read.parquet(f"{sf}/events.parquet").schema)


@query("str_12_daily_context", "WITH " + DAILY + ", p AS (SELECT instrument, session, lag(close) OVER (PARTITION BY instrument ORDER BY session) AS prev_close FROM daily) SELECT event_id, round(price - prev_close, 6) AS gap FROM bars JOIN p USING (instrument, session)")
def daily_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of the stream with the close of the session before."""
    d = W.lagged_daily(daily(spark, sf).select("instrument", "session", "close"), ["close"], ["instrument"], "session").withColumnRenamed("close", "prev_close")
    s = _stream(spark, sf).select(F.col("event_type").alias("instrument"), F.to_date("ts").alias("session"), "event_id", F.col("value").alias("price"))
    out = ST.run_to_table(ST.with_daily_context(s, d, ["instrument", "session"]).select("event_id", "price", "prev_close"), "context")
    return out.select("event_id", F.round(F.col("price") - F.col("prev_close"), 6).alias("gap"))


@query("str_13_depth_rows", "SELECT event_id, round(value + 0.5, 6) AS mid, 1.0::DOUBLE AS spread, (k + 1)::BIGINT AS bid_qty, (k + 3)::BIGINT AS ask_qty, round(-2 / (2 * k + 4), 6) AS imbalance FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE value > 0")
def depth_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of the stream as a poll of a book with one level a side."""
    level = lambda price, more: F.array(F.struct(price.alias("price"), (F.col("k") + more).cast("int").alias("qty"), F.lit(1).alias("orders")))
    s = _stream(spark, sf).where("value > 0").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    s = s.select("event_id", level(F.col("value"), 1).alias("bids"), level(F.col("value") + 1, 3).alias("asks"))
    out = ST.run_to_table(ST.depth_rows(s, "bids", "asks").select("event_id", "mid", "spread", "bid_qty", "ask_qty", "imbalance"), "depth")
    return rounded(out)
