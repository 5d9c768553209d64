"""Queries of joins, selection, chains, labels, functions and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import chain as CH
from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import labels as L
from ..operators import quality as Q
from ..operators import scans as C
from ..operators import select as T
from ..operators import windows as W
from ..sources import readers, writers
from .catalogue import query, r6, rounded
from .views import ATM, BARS, CHAIN, DAILY, HOURLY, KEYS, NUMBERED, ORDER, TRADES, WIDE, bars, chain, daily, hourly, read, spots, trades, wide_chain

# ---------------------------------------------------------------- joins

_SIDES = BARS + ", l AS (SELECT * FROM bars WHERE instrument = 'view'), r AS (SELECT * FROM bars WHERE instrument = 'click')"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = bars(spark, sf)
    return b.where("instrument = 'view'").select("user_id", "ts", "event_id"), b.where("instrument = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), "price")


@query("joi_1_asof_backward", "WITH " + _SIDES + " SELECT l.user_id, l.event_id, r.event_id AS click_id, round(r.price, 6) AS price FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return rounded(J.asof(left, right, ["user_id"], "ts", ["click_id", "price"], ["click_id"]), "user_id", "event_id", "click_id", "price")


@query("joi_1_asof_forward_within_a_day", "WITH " + _SIDES + ", j AS (SELECT l.user_id, l.event_id, l.ts, r.event_id AS click_id, r.ts AS rts FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts) SELECT user_id, event_id, CASE WHEN rts - ts <= INTERVAL 1 DAY THEN click_id END AS click_id FROM j")
def asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return J.asof(left, right, ["user_id"], "ts", ["click_id"], ["click_id"], "forward", tolerance=86400).select("user_id", "event_id", "click_id")


@query("joi_2_exact_lag", "WITH " + HOURLY + " SELECT a.session, a.instrument, a.hr, round(b.close, 6) AS close_lagged FROM hourly a LEFT JOIN hourly b ON a.session = b.session AND a.instrument = b.instrument AND b.hr = a.hr - 2")
def exact_lag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(J.exact_lag(hourly(spark, sf), KEYS, "hr", 2, ["close"]), "session", "instrument", "hr", "close_lagged")


@query(
    "joi_3_history_with_key_guard",
    "WITH " + NUMBERED + """, k AS (SELECT *, floor(price / 5)::BIGINT AS k, epoch_us(ts) // 1000000 AS s FROM b)
SELECT a.instrument, a.event_id, round(arg_max(b.price, b.event_id), 6) AS past FROM k a LEFT JOIN k b ON a.instrument = b.instrument AND a.k = b.k AND b.s <= a.s - 1800 AND b.s >= a.s - 14400 GROUP BY ALL""",
)
def history(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("k", F.floor(F.col("price") / 5)).withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    return b.select("instrument", "event_id", *r6(past=J.history_asof(["instrument", "k"], "s", "price", 1800, 14400)))


@query(
    "joi_4_nearest",
    "WITH " + _SIDES + """, p AS (SELECT l.user_id, l.event_id, r.event_id AS click_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.event_id DESC) AS k FROM l LEFT JOIN r ON l.user_id = r.user_id)
SELECT user_id, event_id, click_id FROM p WHERE k = 1""",
)
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return J.nearest(left, right, ["user_id"], "ts", ["click_id"], ["click_id"]).select("user_id", "event_id", "click_id")


@query("joi_5_6_7_cardinality", "WITH l AS (SELECT o_orderkey AS k, count(*) AS nl FROM orders GROUP BY 1), r AS (SELECT l_orderkey AS k, count(*) AS nr FROM lineitem GROUP BY 1) SELECT sum(nl)::BIGINT AS left_rows, sum(nr)::BIGINT AS right_rows, count(*) FILTER (nl > 1) AS left_repeated, count(*) FILTER (nr > 1) AS right_repeated, coalesce(sum(nl) FILTER (nr IS NULL), 0)::BIGINT AS left_only, coalesce(sum(nr) FILTER (nl IS NULL), 0)::BIGINT AS right_only, sum(nl * nr)::BIGINT AS joined_rows FROM l FULL JOIN r USING (k)")
def cardinality(spark: SparkSession, sf: str) -> DataFrame:
    o, li = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return J.cardinality(o, li, ["k"])


@query("joi_6_one_to_one", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    return J.one_to_one(read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels"), ["doc_id"]).select("doc_id", "lang", "quality")


@query("joi_8_chn_1_sides_pivoted", "WITH " + WIDE + " SELECT ts, strike, round(ce_ltp, 6) AS ce_ltp, ce_oi, ce_volume, round(pe_ltp, 6) AS pe_ltp, pe_oi, pe_volume FROM wide")
def sides_pivoted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wide_chain(spark, sf), "ts", "strike", "ce_ltp", "ce_oi", "ce_volume", "pe_ltp", "pe_oi", "pe_volume")


@query("joi_9_missing_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    return J.missing_keys(read(spark, sf, "customer"), read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("joi_10_src_8_latest_days", "WITH " + BARS + " SELECT session, count(*) AS n FROM bars WHERE session IN (SELECT DISTINCT session FROM bars WHERE session < DATE '2024-01-20' ORDER BY session DESC LIMIT 5) GROUP BY 1")
def latest_days(spark: SparkSession, sf: str) -> DataFrame:
    return J.latest_days(bars(spark, sf), "session", 5, F.lit("2024-01-20").cast("date")).groupBy("session").agg(F.count("*").alias("n"))


@query("joi_11_contract_lookup", "WITH " + ATM + ", c AS (SELECT ts, strike, side, ltp FROM chain) SELECT a.ts, a.atm_strike, round(c.ltp, 6) AS ce_price FROM atm a LEFT JOIN c ON a.ts = c.ts AND a.atm_strike = c.strike AND c.side = 'CE'")
def contract_lookup(spark: SparkSession, sf: str) -> DataFrame:
    atm = CH.at_the_money(wide_chain(spark, sf), ["ts"], spots(spark, sf), "spot").withColumn("side", F.lit("CE"))
    out = J.lookup(atm, chain(spark, sf).withColumnRenamed("ltp", "ce_price"), {"ts": "ts", "atm_strike": "strike", "side": "side"}, ["ce_price"])
    return rounded(out, "ts", "atm_strike", "ce_price")


@query("joi_12_daily_onto_bars", "WITH " + DAILY + ", p AS (SELECT instrument, session, lag(close) OVER (PARTITION BY instrument ORDER BY session) AS pc FROM daily) SELECT b.event_id, round(b.price / p.pc - 1, 6) AS day_return FROM bars b LEFT JOIN p USING (instrument, session)")
def daily_onto_bars(spark: SparkSession, sf: str) -> DataFrame:
    d = W.lagged_daily(daily(spark, sf).select("instrument", "session", F.col("close").alias("pc")), ["pc"], ["instrument"], "session")
    return J.attach_daily(bars(spark, sf), d, ["instrument", "session"]).select("event_id", *r6(day_return=F.col("price") / F.col("pc") - 1))


@query(
    "joi_13_14_15_outer_scores",
    "WITH " + HOURLY + " SELECT session, hr, " + ", ".join(f"round(max(close) FILTER (instrument = '{i}'), 6) AS close_{i}" for i in ("view", "click", "signup")) + " FROM hourly WHERE instrument IN ('view', 'click', 'signup') GROUP BY ALL",
)
def outer_scores(spark: SparkSession, sf: str) -> DataFrame:
    h = hourly(spark, sf)
    per = [h.where(F.col("instrument") == i).select("session", "hr", F.col("close").alias(f"close_{i}")) for i in ("view", "click")]
    third = J.score_table(h.where("instrument = 'signup'"), ["session", "hr"], "instrument", "close", ["signup"])
    return rounded(J.merge_outer([*per, third], ["session", "hr"]))


_SPANS = BARS + ", t AS (SELECT instrument, event_id, user_id, ts AS s, ts + volume * INTERVAL 1 MINUTE AS e FROM bars)"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    return b.select("instrument", "event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + F.make_dt_interval(mins="volume")).alias("e"))


@query("joi_16_purged", "WITH " + _SPANS + " SELECT event_id FROM t a WHERE user_id % 10 <> 3 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.user_id % 10 = 3 AND b.instrument = a.instrument AND b.s <= a.e AND b.e >= a.s)")
def purged(spark: SparkSession, sf: str) -> DataFrame:
    t = _spans(spark, sf)
    held = F.col("user_id") % 10 == 3
    return J.purge_overlaps(t.where(~held), t.where(held), ["instrument"], "s", "e").select("event_id")


@query("joi_17_self_overlaps", "WITH " + _SPANS + " SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM t a JOIN t b ON a.user_id = b.user_id AND a.e > a.s AND b.e > b.s AND (a.s < b.s OR a.s = b.s AND a.event_id < b.event_id) AND a.e > b.s")
def self_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return J.self_overlaps(_spans(spark, sf), ["user_id"], "event_id", "s", "e")


@query(
    "joi_18_20_combine_and_diff",
    "WITH " + DAILY + """, a AS (SELECT instrument, session, close AS x FROM daily WHERE day(session) < 20), b AS (SELECT instrument, session, CASE WHEN day(session) % 7 = 0 THEN close + 1 ELSE close END AS x FROM daily WHERE day(session) > 10)
SELECT instrument, session, round(coalesce(a.x, b.x), 6) AS x, CASE WHEN b.x IS NULL THEN 'left_only' WHEN a.x IS NULL THEN 'right_only' WHEN abs(a.x - b.x) > 1e-9 THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b USING (instrument, session)""",
)
def combine_and_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).select("instrument", "session", F.col("close").alias("x"))
    a, b = d.where(F.day("session") < 20), d.where(F.day("session") > 10).withColumn("x", F.when(F.day("session") % 7 == 0, F.col("x") + 1).otherwise(F.col("x")))
    k = ["instrument", "session"]
    return rounded(J.combine_first(a, b, k).join(J.diff(a, b, k, ["x"]).select(*k, "status"), k))


@query("joi_21_attributed_misses", "WITH m AS (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) SELECT c_custkey, coalesce((SELECT min(o_orderpriority) FROM orders WHERE o_custkey = c_custkey), 'none') AS reason FROM m")
def attributed(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    why = o.groupBy("c_custkey").agg(F.min("o_orderpriority").alias("reason"))
    return J.attribute_misses(read(spark, sf, "customer"), o.where("o_orderstatus = 'F'"), why, ["c_custkey"], "reason", "none")


@query("joi_22_grid_of_rules", "WITH " + TRADES + ", g AS (SELECT unnest([0.0, 0.02, 0.04]::DOUBLE[]) AS t), h AS (SELECT unnest(['F', 'O']) AS s) SELECT t AS threshold, s AS only_side, count(*) AS trades, round(sum(ret), 6) AS net FROM trades JOIN g ON ret >= t JOIN h ON side = s GROUP BY ALL")
def rule_grid(spark: SparkSession, sf: str) -> DataFrame:
    cells = J.grid(spark, threshold=[0.0, 0.02, 0.04], only_side=["F", "O"])
    t = trades(spark, sf)
    met = t.join(F.broadcast(cells), (t.side == cells.only_side) & (t.ret >= cells.threshold))  # six rows
    return rounded(met.groupBy("threshold", "only_side").agg(F.count("*").alias("trades"), F.sum("ret").alias("net")))


# ---------------------------------------------------------------- selection and sets


@query("srt_2_11_latest_per_key", "WITH " + BARS + " SELECT user_id, event_id, round(price, 6) AS price FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM bars) WHERE k = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.latest(bars(spark, sf), ["user_id"], ORDER), "user_id", "event_id", "price")


@query("srt_3_top_per_day", "WITH " + BARS + " SELECT session, event_id, k AS rank FROM (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY price * 2 + coalesce(volume, 0) * 0.5 DESC, ts, event_id))::INTEGER AS k FROM bars) WHERE k <= 3")
def top_per_day(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("score", T.row_score({"price": 2.0, "volume": 0.5}))
    return T.top_n(b, ["session"], [F.desc("score"), "ts", "event_id"], 3).select("session", "event_id", "rank")


@query("srt_4_6_top_fraction", "WITH " + BARS + ", r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY price DESC, event_id) AS k, count(*) OVER (PARTITION BY instrument) AS n FROM bars), f AS (SELECT * FROM r WHERE k <= greatest(1, ceil(n * 0.03))) SELECT instrument, event_id, round(min(price) OVER (PARTITION BY instrument), 6) AS score_floor FROM f")
def top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.top_fraction(bars(spark, sf), ["instrument"], "price", ["event_id"], 0.03), "instrument", "event_id", "score_floor")


@query(
    "srt_5_side_capped",
    "WITH " + TRADES + """, s AS (SELECT side, count(*) AS c, sum(count(*)) OVER () AS a FROM trades WHERE ret > 0.02 GROUP BY side), k AS (SELECT side, CASE WHEN c > 0.45 * a THEN greatest(1, floor(0.45 / 0.55 * (a - c))) ELSE c END AS keep FROM s),
r AS (SELECT id, side, row_number() OVER (PARTITION BY side ORDER BY ret DESC, id) AS n FROM trades WHERE ret > 0.02) SELECT id, r.side FROM r JOIN k ON r.side = k.side WHERE n <= keep""",
)
def side_capped(spark: SparkSession, sf: str) -> DataFrame:
    return T.side_capped(trades(spark, sf).where("ret > 0.02"), "side", "ret", ["id"], 0.45).select("id", "side")


@query("srt_7_8_best_candidate", "WITH " + BARS + " SELECT user_id, arg_min(event_id, {'a': -price, 'b': volume, 'c': event_id}) AS event_id FROM bars WHERE price > 5 AND volume > 10 GROUP BY user_id")
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return T.best_candidate(bars(spark, sf), ["user_id"], [F.desc("price"), "volume", "event_id"], (F.col("price") > 5) & (F.col("volume") > 10)).select("user_id", "event_id")


@query("srt_10_expiry_choice", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), x AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS exp FROM lineitem) SELECT day, coalesce(min(exp) FILTER (exp >= day), max(exp)) AS expiry FROM d, x GROUP BY day")
def expiry_choice(spark: SparkSession, sf: str) -> DataFrame:
    days = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return T.nearest_expiries(days, "day", read(spark, sf, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("date").alias("exp")), "exp", "expiry")


@query("srt_12_page", "WITH " + TRADES + " SELECT id, round(ret, 6) AS ret, rn::INTEGER AS row_number FROM (SELECT *, row_number() OVER (ORDER BY ret DESC, id) AS rn FROM trades) WHERE rn BETWEEN 51 AND 75")
def trade_page(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.page(trades(spark, sf), [F.desc("ret"), "id"], 3, 25), "id", "ret", "row_number")


@query("srt_13_threshold_grid", "WITH " + TRADES + ", g AS (SELECT unnest([0.1, 0.3, 0.5, 0.7]::DOUBLE[]) AS threshold) SELECT threshold, count(*) AS trades, round(sum(ret), 6) AS net, round(avg((ret > 0)::INT), 6) AS win_rate FROM trades JOIN g ON bars_held / 50 >= threshold GROUP BY 1")
def grid_of_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.threshold_grid(trades(spark, sf).withColumn("p", F.col("bars_held") / 50), "p", "ret", [0.1, 0.3, 0.5, 0.7]))


@query("set_2_3_common_and_pending_days", "SELECT day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) WHERE day NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'A')")
def pending(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return writers.pending_days(read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), [li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'")], "day")


@query("set_4_calendar_windows", "SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS \"window\", min(CAST(o_orderdate AS DATE)) AS start_day, max(CAST(o_orderdate AS DATE)) AS end_day, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1")
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    return T.calendar_windows(read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), "day", "quarter")


@query(
    "set_5_walk_forward",
    "WITH " + BARS + """, d AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM bars)), s AS (SELECT unnest(range(0, (SELECT max(n) FROM d) - 17 + 1, 4)) AS s)
SELECT (s // 4)::BIGINT AS fold, CASE WHEN i - s < 8 THEN 'train' WHEN i - s >= 9 AND i - s < 12 THEN 'valid' ELSE 'test' END AS role, session FROM d, s WHERE i - s >= 0 AND i - s < 17 AND i - s <> 8 AND i - s NOT IN (12, 13)""",
)
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return T.walk_forward(bars(spark, sf), "session", 8, 3, 3, 4, purge=1, embargo=2)


@query("set_6_7_splits", "WITH " + BARS + ", d AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT session FROM bars)) SELECT session, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS split FROM d")
def splits(spark: SparkSession, sf: str) -> DataFrame:
    return T.split_days(bars(spark, sf), "session")


@query(
    "agg_34_absent_days",
    """WITH d AS (SELECT DISTINCT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT status, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
c AS (SELECT status, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM r) SELECT status, day FROM c WHERE isodow(day) < 6 EXCEPT SELECT status, day FROM d""",
)
def absent(spark: SparkSession, sf: str) -> DataFrame:
    """Days without an order of each status."""
    return T.absent_days(read(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day")), "day", keys=["status"])


# ---------------------------------------------------------------- chains


@query("agg_2_chain_minutes", "WITH " + CHAIN + " SELECT ts, strike, side, round(ltp, 6) AS ltp, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, oi, volume FROM chain")
def chain_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(chain(spark, sf))


@query("chn_2_totals", "WITH " + WIDE + " SELECT ts, sum(ce_oi) AS ce_oi, sum(pe_oi) AS pe_oi, sum(ce_volume) AS ce_volume, sum(pe_volume) AS pe_volume, count(*) AS strikes, round(sum(pe_oi) / nullif(sum(ce_oi), 0), 6) AS pcr FROM wide GROUP BY ts")
def chain_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(CH.totals(wide_chain(spark, sf), ["ts"]))


@query("chn_3_max_pain", "WITH " + WIDE + ", p AS (SELECT a.ts, a.strike, sum(greatest(a.strike - b.strike, 0) * b.ce_oi + greatest(b.strike - a.strike, 0) * b.pe_oi) AS pain FROM wide a JOIN wide b ON a.ts = b.ts GROUP BY ALL) SELECT ts, arg_min(strike, {'a': round(pain, 6), 'b': strike}) AS max_pain, round(min(pain), 6) AS pain FROM p GROUP BY ts")
def max_pain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(CH.max_pain(wide_chain(spark, sf), ["ts"]))


@query("chn_4_srt_9_at_the_money", "WITH " + ATM + " SELECT ts, atm_strike, spot, round(straddle, 6) AS straddle, round(straddle / spot, 6) AS straddle_pct FROM atm")
def at_the_money(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(CH.at_the_money(wide_chain(spark, sf), ["ts"], spots(spark, sf), "spot"))


@query(
    "chn_5_ladder",
    "WITH " + ATM + """, r AS (SELECT w.*, atm_strike, row_number() OVER (PARTITION BY ts ORDER BY strike) AS r FROM wide w JOIN atm USING (ts)), d AS (SELECT *, abs(r - max(r) FILTER (strike = atm_strike) OVER (PARTITION BY ts)) AS d FROM r)
SELECT ts, """ + ", ".join(f"round(sum(pe_oi) FILTER (d <= {n}) / nullif(sum(ce_oi) FILTER (d <= {n}), 0), 6) AS pcr_{n}, round(sum(ce_oi + pe_oi) FILTER (d <= {n}) / sum(ce_oi + pe_oi), 6) AS oi_share_{n}, round(sum(ce_volume + pe_volume) FILTER (d <= {n}) / sum(ce_volume + pe_volume), 6) AS vol_share_{n}" for n in (1, 3)) + " FROM d GROUP BY ts",
)
def ladder(spark: SparkSession, sf: str) -> DataFrame:
    w = wide_chain(spark, sf)
    return rounded(CH.ladder(w, ["ts"], CH.at_the_money(w, ["ts"], spots(spark, sf), "spot")))


@query("chn_6_8_top_and_step", "WITH " + WIDE + ", g AS (SELECT ts, strike - lag(strike) OVER (PARTITION BY ts ORDER BY strike) AS gap FROM wide), s AS (SELECT ts, min(gap) AS strike_step FROM g GROUP BY ts) SELECT ts, arg_max(strike, {'a': ce_oi, 'b': -strike}) AS ce_top_strike, arg_max(strike, {'a': pe_oi, 'b': -strike}) AS pe_top_strike, any_value(strike_step) AS strike_step FROM wide JOIN s USING (ts) GROUP BY ts")
def top_and_step(spark: SparkSession, sf: str) -> DataFrame:
    w = wide_chain(spark, sf)
    return CH.top_oi(w, ["ts"]).join(CH.strike_step(w, ["ts"]), "ts")


@query(
    "chn_7_microstructure",
    "WITH " + ATM + """, m AS (SELECT w.*, atm_strike, strike - atm_strike AS z, ce_oi + pe_oi AS oi, ce_volume + pe_volume AS vol FROM wide w JOIN atm USING (ts))
SELECT ts, any_value(atm_strike) AS atm_strike, round(sum(oi) FILTER (abs(z) <= 5) / sum(oi), 6) AS oi_concentration, (arg_max(strike, {'a': oi, 'b': -strike}) - any_value(atm_strike))::DOUBLE AS top_oi_distance,
  round(sum(abs(z) * vol) / nullif(sum(vol), 0), 6) AS volume_distance, round(max(greatest(ce_ltp, pe_ltp)) - min(least(ce_ltp, pe_ltp)), 6) AS premium_range, round(coalesce(sum(ce_oi) FILTER (z >= 5), 0) / nullif(sum(pe_oi) FILTER (z <= -5), 0), 6) AS wing_ratio FROM m GROUP BY ts""",
)
def microstructure(spark: SparkSession, sf: str) -> DataFrame:
    w = wide_chain(spark, sf)
    m = CH.microstructure(w, ["ts"], CH.at_the_money(w, ["ts"], spots(spark, sf), "spot"))
    return rounded(m, "ts", "atm_strike", "oi_concentration", "top_oi_distance", "volume_distance", "premium_range", "wing_ratio")


# ---------------------------------------------------------------- labels


@query(
    "lbl_1_triple_barrier",
    "WITH " + HOURLY + """, p AS (SELECT a.session, a.instrument, a.hr, list({'k': b.hr, 'o': b.open, 'h': b.high, 'l': b.low, 'c': b.close} ORDER BY b.hr) AS v FROM hourly a JOIN hourly b ON a.session = b.session AND a.instrument = b.instrument AND b.hr BETWEEN a.hr + 1 AND a.hr + 4 GROUP BY ALL HAVING min(b.hr) = a.hr + 1 AND max(b.hr) = a.hr + 4),
q AS (SELECT *, v[1].o AS e, list_filter(v, lambda b: b.h >= v[1].o * 1.5 OR b.l <= v[1].o * 0.6)[1] AS hit FROM p),
r AS (SELECT *, CASE WHEN hit IS NULL THEN 'time' WHEN hit.h >= e * 1.5 AND hit.l <= e * 0.6 THEN 'tp_sl_same_bar' WHEN hit.h >= e * 1.5 THEN 'tp' ELSE 'sl' END AS reason FROM q)
SELECT h.session, h.instrument, h.hr, coalesce(reason, 'invalid') AS long_reason, round(CASE reason WHEN 'time' THEN v[-1].c / e - 1 WHEN 'sl' THEN e * 0.6 / e - 1 WHEN 'tp' THEN e * 1.5 / e - 1 WHEN 'tp_sl_same_bar' THEN e * 1.5 / e - 1 END, 6) AS long_return,
  round(list_max(list_transform(v, lambda b: b.h)) / e - 1, 6) AS long_mfe, coalesce(hit.k, v[-1].k) - h.hr AS long_offset FROM hourly h LEFT JOIN r USING (session, instrument, hr)""",
)
def triple_barrier(spark: SparkSession, sf: str) -> DataFrame:
    t = L.triple_barrier(hourly(spark, sf), KEYS, "hr", 4, L.barrier_width(0.5), L.barrier_width(0.4))
    return rounded(t, "session", "instrument", "hr", "long_reason", "long_return", "long_mfe", "long_offset")




@query(
    "lbl_5_6_forward_moves",
    "WITH " + BARS + """, x AS (SELECT *, max(price) OVER f - price AS up, price - min(price) OVER f AS down, lead(price, 5) OVER w / price - 1 AS net, sign(lead(price) OVER w - price) AS d FROM bars WINDOW w AS (PARTITION BY session, instrument ORDER BY ts, event_id), f AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
y AS (SELECT *, count(*) FILTER (d > 0) OVER n AS ups, count(*) FILTER (d < 0) OVER n AS downs FROM x WINDOW n AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
SELECT session, instrument, event_id, CASE WHEN up IS NOT NULL THEN (greatest(up, down) >= 40)::INTEGER END AS move_label, CASE WHEN net IS NULL THEN NULL WHEN net >= 0.5 AND ups >= 2 THEN 1 WHEN net <= -0.5 AND downs >= 2 THEN -1 ELSE 0 END AS clean_move FROM y""",
)
def forward_moves(spark: SparkSession, sf: str) -> DataFrame:
    b = L.forward_move(bars(spark, sf), KEYS, ORDER, "price", "price", "price", 5, points=40.0)
    return L.clean_start(b, KEYS, ORDER, "price", 5, 0.5, 2).select(*KEYS, "event_id", "move_label", "clean_move")


@query("lbl_7_clock_return", "WITH " + HOURLY + ", g AS (SELECT session, instrument, max(close) FILTER (hr = 10) AS a, max(close) FILTER (hr = 13) AS b FROM hourly GROUP BY ALL) SELECT session, instrument, round(b / a - 1, 6) AS ret, (b / a - 1 > 0)::INTEGER AS label FROM g WHERE abs(b / a - 1) >= 0.2")
def clock_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.clock_return(hourly(spark, sf), KEYS, "hr", "close", 10, 3, 0.2), "session", "instrument", "ret", "label")


_PATHS = NUMBERED + ", e AS (SELECT session, instrument, event_id AS id, rn, price AS entry FROM b WHERE price > 0), p AS (SELECT e.id, e.entry, x.rn - e.rn AS k, x.price / e.entry - 1 AS pnl FROM e JOIN b x ON x.session = e.session AND x.instrument = e.instrument AND x.rn > e.rn AND x.rn <= e.rn + 10)"


@query(
    "lbl_12_first_touch_exits",
    "WITH " + _PATHS + """, q AS (SELECT *, max(pnl) OVER w AS mfe, min(pnl) OVER w AS mae FROM p WINDOW w AS (PARTITION BY id ORDER BY k)), y AS (SELECT *, CASE WHEN pnl <= -0.5 THEN 'stop' WHEN pnl >= 1.0 THEN 'target' WHEN mfe >= 0.6 AND mfe - pnl >= 0.3 THEN 'trail' WHEN k >= 8 THEN 'time_stop' END AS why FROM q),
z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (why IS NULL), CASE WHEN why IS NULL THEN -k ELSE k END) AS o FROM y) SELECT id, k::INTEGER AS exit_step, coalesce(why, 'end') AS exit_reason, round(pnl, 6) AS pnl, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM z WHERE o = 1""",
)
def first_touch_exits(spark: SparkSession, sf: str) -> DataFrame:
    _w = W.over(KEYS, ORDER)
    b = bars(spark, sf).withColumn("rn", F.row_number().over(_w))
    path = F.collect_list(F.struct("rn", "price")).over(_w.rowsBetween(1, 10))
    e = b.withColumn("path", path).where("price > 0").select(F.col("event_id").alias("id"), F.col("price").alias("entry"), F.col("rn").alias("r0"), F.explode("path").alias("x"))
    p = e.select("id", "entry", (F.col("x.rn") - F.col("r0")).alias("k"), F.col("x.price").alias("now"))
    return rounded(L.first_touch(p, "entry", "now", "k", stop=0.5, target=1.0, trail_arm=0.6, trail_back=0.3, time_stop=8))


@query("lbl_14_16_breach_and_class", "WITH " + NUMBERED + ", x AS (SELECT session, instrument, min(ts) FILTER (price > 100) AS first_breach, count(*) FILTER (price > 100) AS breaches, max(price) - first(price ORDER BY ts, event_id) AS up, first(price ORDER BY ts, event_id) - min(price) AS down FROM b GROUP BY ALL) SELECT session, instrument, first_breach, breaches, CASE WHEN up < 20 AND down < 20 THEN 'NO_MOVE' WHEN up >= 20 AND down >= 20 THEN 'CHOP' WHEN up >= 100 THEN 'BIG_UP' WHEN down >= 100 THEN 'BIG_DOWN' WHEN up >= 20 THEN 'SMALL_UP' WHEN down >= 20 THEN 'SMALL_DOWN' END AS move FROM x")
def breach_and_class(spark: SparkSession, sf: str) -> DataFrame:
    o = F.min_by("price", F.struct(*ORDER))
    g = bars(spark, sf).groupBy(*KEYS).agg(*L.first_breach(KEYS, "ts", F.col("price") > 100), (F.max("price") - o).alias("up"), (o - F.min("price")).alias("down"))
    return g.select(*KEYS, "first_breach", "breaches", L.move_class("up", "down", 20, 100).alias("move"))


# ---------------------------------------------------------------- functions and filters


@query("fun_1_2_prj_1_contracts", "SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS underlying, DATE '2024-01-25' AS expiry, (20000 + p_size * 100)::DOUBLE AS strike, CASE WHEN p_size % 2 = 0 THEN 'CE' ELSE 'PE' END AS side FROM part")
def contracts(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    symbol = F.concat(F.upper(F.split("p_name", " ")[0]), F.lit("25JAN24"), (20000 + F.col("p_size") * 100).cast("string"), F.when(F.col("p_size") % 2 == 0, "CE").otherwise("PE"))
    return p.select("p_partkey", S.contract_fields(symbol).alias("c")).select("p_partkey", "c.*")


@query("fun_3_4_reasons", "SELECT o_orderkey, regexp_extract(o_orderpriority, '^(\\d)', 1) AS level, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9_]+', '_', 'g')) AS code FROM orders")
def reasons(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    text = F.concat(F.lit("[day] rule: level="), F.substring("o_orderpriority", 1, 1), F.lit(", status="), "o_orderstatus")
    return o.select("o_orderkey", S.reason_token(text, "level").alias("level"), S.reason_code("o_orderpriority").alias("code"))


@query("fun_5_clock_fields", "SELECT event_id, (hour(ts) * 60 + minute(ts))::INTEGER AS minute, date_trunc('minute', ts) AS minute_ts, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter_ts, (isodow(ts) - 1)::INTEGER AS dow, CASE WHEN hour(ts) * 60 + minute(ts) >= 555 THEN (hour(ts) * 60 + minute(ts) - 555)::INTEGER END AS since_open, CASE WHEN hour(ts) BETWEEN 9 AND 11 THEN 'MORNING' WHEN hour(ts) BETWEEN 12 AND 15 THEN 'MIDDAY' END AS phase FROM events")
def clock_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select("event_id", S.minute_of_day("ts").alias("minute"), S.bar_floor("ts", 1).alias("minute_ts"), S.bar_floor("ts", 15).alias("quarter_ts"), S.monday_zero("ts").alias("dow"), S.minutes_since("ts", 555).alias("since_open"), S.session_phase("ts", [("MORNING", 540, 720), ("MIDDAY", 720, 960)]).alias("phase"))


@query("fun_9_14_numbers", "SELECT o_orderkey, (round_even(o_totalprice / 100, 0) * 100) AS step, sign(o_totalprice - 50000)::INTEGER AS side, round(40 + o_totalprice * 2 * 10 / 10000, 6) AS cost FROM orders")
def numbers(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", S.round_to_step("o_totalprice", 100).alias("step"), S.dead_sign(F.col("o_totalprice") - 50000).alias("side"), *r6(cost=S.trading_cost("o_totalprice", "o_totalprice")["total"]))


@query("fun_10_slopes", "WITH e AS (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings) SELECT vec_id, round(regr_slope(y::DOUBLE, x), 5) AS slope FROM e GROUP BY vec_id")
def slopes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.round(S.slope("embedding", normal=False), 5).alias("slope"))


@query(
    "fun_15_book_metrics",
    "WITH " + NUMBERED + """, g AS (SELECT session, instrument, list(price ORDER BY rn)[1:3] AS p, list(volume ORDER BY rn)[1:3] AS q, list(price ORDER BY rn DESC)[1:3] AS ap, list(volume ORDER BY rn DESC)[1:3] AS aq FROM b GROUP BY ALL)
SELECT session, instrument, round((p[1] + ap[1]) / 2, 6) AS mid, list_sum(q)::BIGINT AS bid_qty, list_sum(aq)::BIGINT AS ask_qty, round((list_sum(q) - list_sum(aq)) / nullif(list_sum(q) + list_sum(aq), 0), 6) AS imbalance FROM g WHERE p[1] > 0 AND ap[1] > 0""",
)
def books(spark: SparkSession, sf: str) -> DataFrame:
    lvl = F.struct(F.col("ts"), F.col("event_id"), F.struct(F.col("price"), F.col("volume").alias("qty"), F.lit(1).alias("orders")).alias("l"))
    g = bars(spark, sf).groupBy(*KEYS).agg(F.array_sort(F.collect_list(lvl)).alias("a"))
    first, last = F.slice("a", 1, 3), F.slice(F.reverse("a"), 1, 3)
    x = g.select(*KEYS, S.book_metrics(F.transform(first, lambda v: v["l"]), F.transform(last, lambda v: v["l"])).alias("m")).where("m.mid is not null")
    return rounded(x.select(*KEYS, "m.mid", "m.bid_qty", "m.ask_qty", "m.imbalance"))


@query("flt_6_7_rule_signals", "WITH " + BARS + " SELECT event_id FROM bars WHERE price > 10 AND volume >= 20 AND NOT (instrument = 'error' OR price > 200) AND NOT (price > 50 AND volume > 80)")
def rule_signals(spark: SparkSession, sf: str) -> DataFrame:
    c = lambda a, o, v: {"column": a, "operator": o, "value": v}
    rule = {"entry_conditions": [c("price", ">", 10.0), c("volume", ">=", 20)], "disqualifiers": [c("instrument", "==", "error"), c("price", ">", 200.0)], "disqualifier_all_of": [[c("price", ">", 50.0), c("volume", ">", 80)]]}
    return bars(spark, sf).where(S.rule_signal(rule)).select("event_id")


@query("flt_1_2_3_5_date_and_clock", "WITH " + BARS + " SELECT session, instrument, max_by(event_id, {'a': ts, 'b': event_id}) AS event_id, count(*) AS n FROM bars WHERE session BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' AND hour(ts) * 60 + minute(ts) BETWEEN 600 AND 690 GROUP BY ALL")
def date_and_clock(spark: SparkSession, sf: str) -> DataFrame:
    b = readers.date_range(bars(spark, sf), "session", F.lit("2024-01-05").cast("date"), F.lit("2024-01-15").cast("date")).where(S.minute_of_day("ts").between(600, 690))
    return b.groupBy(*KEYS).agg(F.max_by("event_id", F.struct(*ORDER)).alias("event_id"), F.count("*").alias("n"))


@query("fun_18_to_22_regimes", "WITH " + DAILY + ", x AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY session) - 1 AS r, (high - low) / nullif(low, 0) AS v FROM daily) SELECT instrument, session, CASE WHEN v >= 500 THEN 'VOLATILE' WHEN r > 0.5 THEN 'TREND_UP' WHEN r < -0.5 THEN 'TREND_DOWN' ELSE 'SIDEWAYS' END AS regime FROM x")
def regimes(spark: SparkSession, sf: str) -> DataFrame:
    w = W.over(["instrument"], ["session"])
    d = daily(spark, sf).withColumn("r", W.k_return("close", 1, w)).withColumn("v", S.safe_divide(F.col("high") - F.col("low"), "low"))
    return d.select("instrument", "session", S.first_true([("VOLATILE", F.col("v") >= 500), ("TREND_UP", F.col("r") > 0.5), ("TREND_DOWN", F.col("r") < -0.5)], "SIDEWAYS").alias("regime"))


# ---------------------------------------------------------------- sources, sinks and quality


@query("src_4_to_7_snk_1_2_day_replace", "WITH " + BARS + " SELECT session, count(*) AS n, round(sum(price), 4) AS total FROM bars WHERE session BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY 1")
def day_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Write all days, rewrite some of them, read a range back: the rewrite is idempotent."""
    root = writers.scratch(spark, "days")
    b = bars(spark, sf).select("session", "instrument", "ts", "event_id", "price")
    writers.write_days(b, root, "session", ORDER)
    writers.write_days(b.where("session >= date'2024-01-10' and session < date'2024-01-15'"), root, "session", ORDER)
    back = readers.date_range(readers.parquet_dataset(spark, root, "ts"), "session", F.lit("2024-01-03").cast("date"), F.lit("2024-01-25").cast("date"))
    return back.groupBy("session").agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("total"))


@query("src_11_fun_23_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return readers.json_column(read(spark, sf, "events"), "props", "k int").select("event_id", "parsed.k")


@query("snk_4_upsert", "WITH " + BARS + " SELECT user_id, max(event_id) AS event_id FROM bars GROUP BY 1")
def upserts(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select("user_id", "ts", "event_id")
    one = writers.upserted(None, b.where("event_id % 3 <> 0"), ["user_id"], ORDER)
    return writers.upserted(one, b.where("event_id % 3 <> 1"), ["user_id"], ORDER).select("user_id", "event_id")


@query("snk_5_7_split_by_type", "WITH " + BARS + " SELECT instrument, count(*) AS n FROM bars WHERE price <= 50 GROUP BY 1")
def split_by_type(spark: SparkSession, sf: str) -> DataFrame:
    root = writers.scratch(spark, "types")
    good, _ = writers.split(bars(spark, sf).withColumn("reason", F.when(F.col("price") > 50, "too_dear")), "reason")
    writers.write_by_type(good.select("instrument", "event_id", "price"), root, "instrument")
    return spark.read.parquet(root).groupBy("instrument").agg(F.count("*").alias("n"))


@query("dqc_2_key_duplicates", "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) SELECT coalesce(sum(n), 0)::BIGINT AS rows_in_repeated, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows, count(*) AS repeated_keys FROM g")
def key_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return Q.key_duplicates(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dqc_3_4_violations", "SELECT count(*) AS rows, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'O') AS o_orderstatus_constant, count(*) FILTER (NOT coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false)) AS o_orderpriority_allowed FROM orders")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    return Q.value_violations(read(spark, sf, "orders"), {"o_orderstatus": "O"}, {"o_orderpriority": ["1-URGENT", "2-HIGH"]})


@query("dqc_5_completeness", "WITH " + NUMBERED + ", x AS (SELECT *, lag(price, 3) OVER (PARTITION BY session, instrument ORDER BY ts, event_id) AS back, CASE WHEN volume > 2 THEN volume END AS vol FROM b) SELECT session, instrument, c AS \"column\", count(*) AS eligible, round(avg(f::INT), 6) AS filled, avg(f::INT) >= 0.98 AS ok FROM (SELECT session, instrument, 'back' AS c, back IS NOT NULL AS f FROM x WHERE rn > 2 UNION ALL SELECT session, instrument, 'vol', vol IS NOT NULL FROM x) GROUP BY ALL")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    _w = W.over(KEYS, ORDER)
    b = bars(spark, sf).withColumn("back", F.lag("price", 3).over(_w)).withColumn("vol", F.when(F.col("volume") > 2, F.col("volume")))
    return rounded(Q.completeness(b, KEYS, ORDER, {"back": 2, "vol": 0}))


@query("dqc_7_prj_14_missing_rates", "WITH x AS (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'quality' AS \"column\", round(avg((quality IS NULL)::INT), 6) AS missing_rate FROM x UNION ALL SELECT 'toxic', round(avg((toxic IS NULL)::INT), 6) FROM x")
def missing_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.missing_rates(read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left"), ["quality", "toxic"]))


@query("dqc_8_clock_leaks", "WITH " + NUMBERED + ", x AS (SELECT hour(ts) AS h, CASE WHEN hour(ts) >= 12 THEN price END AS a, CASE WHEN rn > 3 THEN price END AS c FROM b) SELECT k AS \"column\", round(avg(f::INT) FILTER (h < 12), 6) AS before, round(avg(f::INT) FILTER (h >= 12), 6) AS after, avg(f::INT) FILTER (h < 12) <= 0.05 AND avg(f::INT) FILTER (h >= 12) >= 0.95 AS ok FROM (SELECT h, 'a' AS k, a IS NOT NULL AS f FROM x UNION ALL SELECT h, 'c', c IS NOT NULL FROM x) GROUP BY k")
def clock_leaks(spark: SparkSession, sf: str) -> DataFrame:
    _w = W.over(KEYS, ORDER)
    b = bars(spark, sf).withColumn("h", F.hour("ts")).withColumn("a", F.when(F.col("h") >= 12, F.col("price"))).withColumn("c", F.when(F.row_number().over(_w) > 3, F.col("price")))
    return rounded(Q.clock_leaks(b, "h", 12, ["a", "c"]))


@query("dqc_9_10_day_bands", "WITH " + BARS + " SELECT session, count(*) AS rows, CASE WHEN count(*) >= 340 THEN 'OK' WHEN count(*) >= 320 THEN 'WARN' ELSE 'ERROR' END AS status FROM bars GROUP BY 1")
def day_bands(spark: SparkSession, sf: str) -> DataFrame:
    return Q.row_count_bands(bars(spark, sf), "session", 340, 320)


@query(
    "dqc_11_latest_block",
    """WITH d AS (SELECT o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS day, count(*) % 5 <> 1 AS good FROM orders GROUP BY ALL), x AS (SELECT * FROM (SELECT *, max(day) FILTER (good) OVER (PARTITION BY kind) AS last FROM d) WHERE day <= last),
y AS (SELECT *, (NOT good OR coalesce(day - lag(day) OVER w > 3, false) OR coalesce(NOT lag(good) OVER w, false))::INT AS new FROM x WINDOW w AS (PARTITION BY kind ORDER BY day)), g AS (SELECT *, sum(new) OVER (PARTITION BY kind ORDER BY day) AS g FROM y),
t AS (SELECT *, max(g) FILTER (good) OVER (PARTITION BY kind) AS top FROM g) SELECT kind, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM t WHERE good AND g = top GROUP BY 1""",
)
def latest_block(spark: SparkSession, sf: str) -> DataFrame:
    """Of each priority the last run of days whose orders pass a check."""
    d = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("day")).agg((F.count("*") % 5 != 1).alias("good"))
    return Q.latest_block(d, "day", "good", 3, ["kind"])


@query("agg_4_5_6_coverage", "SELECT lang, count(*) AS rows, count(quality) AS n_quality, 0::BIGINT AS n_nothing, min(source) AS lowest, max(source) AS highest FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "lang", "source").join(read(spark, sf, "labels"), "doc_id", "left")
    return E.field_coverage(d, ["lang"], ["quality", "nothing"]).join(E.text_coverage(d, ["lang"], "source").select("lang", "lowest", "highest"), "lang")


@query("scn_8_9_drawdown", "WITH " + TRADES + ", e AS (SELECT regime, day, id, ret, 1 + sum(ret) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY regime ORDER BY day, id)), p AS (SELECT *, greatest(1.0, max(equity) OVER (PARTITION BY regime ORDER BY day, id)) AS peak FROM e) SELECT regime, round(-min(equity - peak), 6) AS max_drawdown FROM p GROUP BY regime")
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.max_drawdown(trades(spark, sf), "ret", ["regime"], ["day", "id"]))


@query("scn_10_streaks", "WITH " + TRADES + ", s AS (SELECT regime, day, id, sign(ret) AS s FROM trades), g AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY day, id) - row_number() OVER (PARTITION BY regime, s ORDER BY day, id) AS g FROM s), r AS (SELECT regime, s, count(*) AS n FROM g GROUP BY regime, s, g) SELECT regime, coalesce(max(n) FILTER (s = 1), 0) AS win_streak, coalesce(max(n) FILTER (s = -1), 0) AS loss_streak FROM r GROUP BY regime")
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    return C.streaks(trades(spark, sf), "ret", ["regime"], ["day", "id"])



