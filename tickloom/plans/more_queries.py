"""Further queries: projections of nested rows, option paths, oracle labels, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import chain as CH
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import select as T
from .catalogue import query, rounded
from .views import ATM, BARS, DAILY, TRADES, bars, chain, daily, read, spots, trades, wide_chain


@query("prj_2_to_6_parsed_columns", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) END AS price, NULL::DOUBLE AS oi FROM orders")
def parsed_columns(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    raw = o.select("o_orderkey", text.alias(" Trade Date "), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.round("o_totalprice", 2).cast("string")).alias("Last"))
    df = S.ensure_columns(S.rename_synonyms(S.normalize_columns(raw), {"price": ["close", "last"]}), {"oi": "double"})
    return df.select("o_orderkey", S.parse_date("trade_date").alias("day"), S.number("price").alias("price"), "oi")


@query("prj_7_to_11_nested_views", "WITH " + BARS + " SELECT event_id, round(price, 6) AS price, volume::DOUBLE AS volume, round(coalesce(CASE WHEN volume > 50 THEN price END, 0.5 * price), 6) AS mark, 'v1' AS version, NULL::DOUBLE AS missing FROM bars")
def nested_views(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("event_id", F.struct("price", F.lit(0).alias("volume")).alias("bar"), F.struct("volume", F.when(F.col("volume") > 50, F.col("price")).alias("mark_price")).alias("flow"))
    flat = S.flattened(b, ["bar", "flow"], ["event_id"])
    flat = S.flat_projection(flat, {"event_id": (["event_id"], None), "price": (["price"], None), "volume": (["volume"], None), "mark": (["mark", "mark_price"], 0.5 * F.col("price"))}, {"event_id": "long"})
    flat = S.with_lineage(flat, version="v1")
    return rounded(S.view(flat, {"event_id": ("event_id", "long"), "price": ("price", "double"), "volume": ("volume", "double"), "mark": ("mark", "double"), "version": ("version", "string"), "missing": ("no.such", "double")}))


@query(
    "lbl_4_option_paths",
    "WITH " + ATM + """, q AS (SELECT (year(ts) * 12 + month(ts))::INTEGER AS m, strike, side, ltp AS c FROM chain), e AS (SELECT (year(ts) * 12 + month(ts))::INTEGER AS m, atm_strike FROM atm),
r AS (SELECT * FROM (VALUES ('near', 'CE', 0, 3, 0.3, 0.3), ('far', 'PE', 2, 4, 0.2, 0.6)) t(recipe_id, side, steps, hold, s, t)),
x AS (SELECT e.m, recipe_id, r.side, atm_strike + CASE WHEN r.side = 'CE' THEN 1 ELSE -1 END * steps AS strike, hold, s, t FROM e, r), y AS (SELECT x.*, q.c AS e FROM x LEFT JOIN q ON q.m = x.m AND q.strike = x.strike AND q.side = x.side),
p AS (SELECT y.m, y.recipe_id, q.m - y.m AS k, q.c, q.c <= y.e * (1 - s) OR q.c >= y.e * (1 + t) AS hit FROM y JOIN q ON q.strike = y.strike AND q.side = y.side AND q.m > y.m AND q.m <= y.m + y.hold),
h AS (SELECT m, recipe_id, min(k) FILTER (hit) AS hk FROM p GROUP BY ALL), z AS (SELECT y.*, hk, coalesce(hk, hold) AS upto, (SELECT count(*) FROM p WHERE p.m = y.m AND p.recipe_id = y.recipe_id AND p.k <= coalesce(hk, hold)) AS have FROM y LEFT JOIN h ON h.m = y.m AND h.recipe_id = y.recipe_id)
SELECT z.m AS id, z.recipe_id, z.strike, round(e, 6) AS entry_premium, CASE WHEN e IS NULL OR e <= 0 THEN 'no_entry_quote' WHEN have < upto THEN 'missing_path' END AS reason_skipped,
  CASE WHEN e > 0 AND have >= upto THEN CASE WHEN hk IS NULL THEN 'max_hold' WHEN p.c <= e * (1 - s) THEN 'stop' ELSE 'target' END END AS exit_reason, round(CASE WHEN e > 0 AND have >= upto THEN p.c / e - 1 END, 6) AS pnl_pct
FROM z LEFT JOIN p ON p.m = z.m AND p.recipe_id = z.recipe_id AND p.k = z.upto""",
)
def option_paths(spark: SparkSession, sf: str) -> DataFrame:
    month = (F.year("ts") * 12 + F.month("ts")).alias("minute")
    atm = CH.at_the_money(wide_chain(spark, sf), ["ts"], spots(spark, sf), "spot")
    entries = atm.select((F.year("ts") * 12 + F.month("ts")).alias("id"), F.lit("k").alias("key"), month, "atm_strike", F.lit(1).alias("strike_step"))
    quotes = chain(spark, sf).select(F.lit("k").alias("key"), month, "strike", "side", F.col("ltp").alias("close"))
    recipes = spark.createDataFrame([("near", "CE", 0, 3, 0.3, 0.3), ("far", "PE", 2, 4, 0.2, 0.6)], "recipe_id string, side string, steps int, hold int, stop_pct double, target_pct double")
    out = L.option_path(entries, quotes, recipes, ["key"])
    return rounded(out, "id", "recipe_id", "strike", "entry_premium", "reason_skipped", "exit_reason", "pnl_pct")


@query("lbl_8_srt_7_oracle", "WITH " + TRADES + ", b AS (SELECT cust, arg_min({'r': regime, 's': side}, {'a': -ret, 'b': mae, 'c': bars_held, 'd': mfe, 'e': regime, 'f': side}) FILTER (ret > 0) AS x, max(ret) AS m FROM trades GROUP BY cust) SELECT cust, (m > 0)::INTEGER AS entry_label, CASE WHEN m > 0 THEN x.s END AS direction_label, CASE WHEN m > 0 THEN x.r END AS recipe_label, round(CASE WHEN m > 0 THEN m END, 6) AS best_return FROM b")
def oracle_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = trades(spark, sf).select("cust", F.col("regime").alias("recipe_id"), "side", F.col("ret").alias("net_return"), "mae", F.col("bars_held").alias("hold"), F.col("mfe").alias("stop_pct"))
    return rounded(L.oracle(c, ["cust"]))


@query("agg_7_16_first_filled", "WITH " + TRADES + " SELECT cust, min_by(CASE WHEN side = 'F' THEN regime ELSE '' END, {'a': day, 'b': id}) FILTER (side = 'F') AS note FROM trades GROUP BY cust")
def first_filled(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).withColumn("note", F.when(F.col("side") == "F", F.col("regime")).otherwise(""))
    return E.first_filled(t, ["cust"], "note", ["day", "id"])


@query("agg_29_window_diagnostics", "WITH " + TRADES + " SELECT year(day)::INTEGER AS yr, round(avg((side = 'F')::INT), 6) AS is_f, round(median(bars_held), 6) AS bars_held FROM trades GROUP BY 1")
def window_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).withColumn("yr", F.year("day")).withColumn("is_f", F.col("side") == "F")
    return rounded(E.window_diagnostics(t, ["yr"], ["is_f"], ["bars_held"]))


@query("evl_16_monotone", "WITH " + DAILY + ", d AS (SELECT instrument, session, high < lag(high) OVER (PARTITION BY instrument ORDER BY session) AS f FROM daily) SELECT instrument, coalesce(count(*) FILTER (f), 0)::BIGINT AS falls, coalesce(count(*) FILTER (f), 0) = 0 AS monotone FROM d GROUP BY 1")
def monotone(spark: SparkSession, sf: str) -> DataFrame:
    return E.monotone(daily(spark, sf), ["instrument"], "session", "high")


@query("evl_10_22_policy", "WITH " + TRADES + ", u AS (SELECT id, regime AS recipe_id, side, ret FROM trades), p AS (SELECT id, CASE WHEN bars_held > 30 THEN 'F' WHEN bars_held > 15 THEN 'O' END AS side, '1-URGENT' AS recipe_id FROM trades), j AS (SELECT p.id, p.side, u.ret FROM p LEFT JOIN u ON u.id = p.id AND u.side = p.side AND u.recipe_id = p.recipe_id) SELECT count(ret) AS trades, round(1 - avg((ret IS NOT NULL)::INT), 6) AS block_rate, round(coalesce(sum(ret), 0), 6) AS net, round(avg((ret > 0)::INT) FILTER (ret IS NOT NULL), 6) AS win_rate FROM j")
def policy(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf)
    u = t.select("id", F.col("regime").alias("recipe_id"), "side", F.col("ret").alias("net_return"))
    action = F.when(F.col("bars_held") > 30, "F").when(F.col("bars_held") > 15, "O")
    return rounded(E.policy_evaluation(t.select("id", "bars_held"), u, ["id"], action, F.lit("1-URGENT")), "trades", "block_rate", "net", "win_rate")


@query("srt_8_argmax", "WITH " + DAILY + " SELECT instrument, session, CASE WHEN open >= high - low AND open >= close THEN 'open' WHEN close >= high - low THEN 'close' ELSE 'span' END AS best FROM daily WHERE open <> close AND open <> high - low AND close <> high - low")
def argmax(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).withColumn("span", F.col("high") - F.col("low")).where("open <> close and open <> span and close <> span")
    return d.select("instrument", "session", T.argmax({"open": "open", "close": "close", "span": "span"})["name"].alias("best"))
