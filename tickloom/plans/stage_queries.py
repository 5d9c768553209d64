"""Queries of the training stages: filters with counts, stage labels, swing exits, volatility block and enriched trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import labels as L
from ..operators import stages as G
from .catalogue import query, rounded
from .views import DAILY, HOURLY, TRADES, daily, hourly, read, trades

HOUR = ["session", "instrument", "hr"]


def utilities(spark: SparkSession, sf: str) -> DataFrame:
    """Per hour the return of going long or short to the next one, with labels."""
    nx = F.lead("close").over(Window.partitionBy("session", "instrument").orderBy("hr"))
    gain = S.safe_divide(nx, "close")
    h = hourly(spark, sf).withColumn("gain", gain).withColumns({"ce": F.round(F.col("gain") - 1, 6), "pe": F.round(1 - F.col("gain") - 0.01, 6)})
    return h.select(*HOUR, "ce", "pe", (F.coalesce(F.greatest("ce", "pe"), F.lit(0.0)) > 0.02).cast("int").alias("entry_label"), F.when(F.col("ce") >= F.col("pe"), "CE").when(F.col("ce") < F.col("pe"), "PE").alias("direction_label"))


UTIL = HOURLY + """, gains AS (SELECT *, lead(close) OVER (PARTITION BY session, instrument ORDER BY hr) / nullif(close, 0) AS gain FROM hourly),
u0 AS (SELECT session, instrument, hr, round(gain - 1, 6) AS ce, round(1 - gain - 0.01, 6) AS pe FROM gains),
util AS (SELECT *, (coalesce(greatest(ce, pe), 0) > 0.02)::INTEGER AS entry_label, CASE WHEN ce >= pe THEN 'CE' WHEN ce < pe THEN 'PE' END AS direction_label, abs(coalesce(ce, 0) - coalesce(pe, 0)) AS edge,
  coalesce(CASE WHEN direction_label = 'CE' THEN ce ELSE pe END, 0) AS winner, coalesce(CASE WHEN direction_label = 'CE' THEN pe ELSE ce END, 0) AS opposing FROM u0)"""


@query(
    "flt_4_expiry_days",
    "WITH " + UTIL + ", x AS (SELECT *, isodow(session) = 4 AS expiry FROM util) SELECT session, instrument, hr, (SELECT count(*) FROM x) AS rows_before, (SELECT count(*) FROM x WHERE expiry) AS expiry_dropped FROM x WHERE NOT expiry",
)
def without_expiry_days(spark: SparkSession, sf: str) -> DataFrame:
    u = utilities(spark, sf)
    context = hourly(spark, sf).select(*HOUR, S.days_to_expiry(S.parse_expiry(F.lit(""), "session"), "session").alias("dte"))
    rows, counts = G.without_expiry_days(u, context, HOUR)
    return rows.select(*HOUR).crossJoin(counts.select("rows_before", "expiry_dropped"))  # one row of counts


@query(
    "flt_8_label_filter",
    "WITH " + UTIL + """, x AS (SELECT *, edge >= 0.05 AS a, winner > 0 AND opposing <= 0.3 AS b FROM util) SELECT session, instrument, hr, round(edge, 6) AS edge,
(SELECT count(*) FROM x WHERE NOT a) AS edge_dropped, (SELECT count(*) FROM x WHERE a AND NOT b) AS winner_dropped FROM x WHERE a AND b""",
)
def label_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows, counts = G.label_filter(utilities(spark, sf), 0.05, True, 0.3)
    return rounded(rows.select(*HOUR, "edge").crossJoin(counts.select("edge_dropped", "winner_dropped")))


@query("flt_9_decisive_edge", "WITH " + UTIL + " SELECT session, instrument, hr, ce, pe FROM util WHERE edge >= 0.1 AND instrument IN ('view', 'click', 'purchase')")
def decisive(spark: SparkSession, sf: str) -> DataFrame:
    return G.decisive(utilities(spark, sf), 0.1, "instrument", ("view", "click", "purchase")).select(*HOUR, "ce", "pe")


@query("flt_10_regime_gate", "WITH " + DAILY + ", x AS (SELECT *, lag(high - low) OVER (PARTITION BY instrument ORDER BY session) AS before FROM daily) SELECT instrument, session, round(close, 6) AS close FROM x WHERE NOT coalesce(before > 300, true)")
def regime_gate(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag(F.col("high") - F.col("low")).over(Window.partitionBy("instrument").orderBy("session"))
    d = daily(spark, sf).withColumn("before", before)
    return rounded(d.where(~G.blocks(F.col("before") > 300)), "instrument", "session", "close")


@query("flt_11_filled", "SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL AND lang <> '' AND source IS NOT NULL AND source <> ''")
def filled(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where(G.is_filled("lang") & G.is_filled("source")).select("doc_id", "lang", "source")


@query(
    "lbl_9_move_labels",
    "WITH " + UTIL + """, f AS (SELECT session, instrument, hr, max(high) OVER w - close AS up, close - min(low) OVER w AS down FROM hourly WINDOW w AS (PARTITION BY session, instrument ORDER BY hr ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
m AS (SELECT *, (greatest(up, down) >= 60)::INTEGER AS entry_label, (up IS NOT NULL)::INTEGER AS entry_label_valid FROM f WHERE hr >= 4)
SELECT u.session, u.instrument, u.hr, u.ce, u.pe, u.direction_label, coalesce(m.entry_label, 0) AS entry_label, coalesce(m.entry_label_valid, 0) AS entry_label_valid, round(m.up, 6) AS move_up, round(m.down, 6) AS move_down FROM util u LEFT JOIN m USING (session, instrument, hr)""",
)
def move_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = L.forward_move(hourly(spark, sf), ["session", "instrument"], ["hr"], "close", "high", "low", 3, points=60)
    m = m.where("hr >= 4").withColumns({"entry_label": F.col("move_label"), "entry_label_valid": F.col("move_up").isNotNull().cast("int")})
    out = G.with_move_labels(utilities(spark, sf), m, HOUR, ["entry_label", "entry_label_valid", "move_up", "move_down"])
    return rounded(out.select(*HOUR, "ce", "pe", "direction_label", "entry_label", "entry_label_valid", "move_up", "move_down"))


_THRESHOLDS = {"min_edge": 0.05, "min_winner": 0.03, "max_opposing": 0.5, "share": 0.25}
_CONVICTED = """, pass AS (SELECT *, least(edge, winner) AS conviction, row_number() OVER (PARTITION BY instrument ORDER BY least(edge, winner) DESC, session, hr) AS k, greatest(1, ceil(count(*) OVER (PARTITION BY instrument) * 0.25)) AS n FROM {rows}
  WHERE edge >= 0.05 AND winner >= 0.03 AND opposing <= 0.5)"""


@query(
    "lbl_10_stage_labels",
    "WITH " + UTIL + ", sided AS (SELECT * FROM util WHERE entry_label = 1 AND direction_label IN ('CE', 'PE'))" + _CONVICTED.format(rows="sided") + """, stages AS (
SELECT 'entry' AS stage, session, instrument, hr, entry_label AS move_label, NULL AS side FROM util
UNION ALL SELECT 'direction', session, instrument, hr, 1, CASE WHEN direction_label = 'CE' THEN 'up' ELSE 'down' END FROM sided
UNION ALL SELECT 'market', session, instrument, hr, 1, CASE WHEN coalesce(ce, 0) > coalesce(pe, 0) THEN 'up' ELSE 'down' END FROM util WHERE entry_label = 1 AND edge >= 0.1
UNION ALL SELECT 'market_all', session, instrument, hr, 1, CASE WHEN coalesce(ce, 0) > coalesce(pe, 0) THEN 'up' ELSE 'down' END FROM util WHERE edge >= 0.1
UNION ALL SELECT 'ce_win', session, instrument, hr, 1, CASE WHEN ce > 0 THEN 'up' ELSE 'down' END FROM util WHERE abs(ce) >= 0.02
UNION ALL SELECT 'pe_win', session, instrument, hr, 1, CASE WHEN pe > 0 THEN 'up' ELSE 'down' END FROM util WHERE abs(pe) >= 0.02
UNION ALL SELECT 'recipe', session, instrument, hr, (direction_label = 'CE')::INTEGER, NULL FROM util WHERE entry_label = 1
UNION ALL SELECT 'direction_or_no_trade', s.session, s.instrument, s.hr, (p.k IS NOT NULL)::INTEGER, CASE WHEN s.direction_label = 'CE' THEN 'up' ELSE 'down' END FROM sided s LEFT JOIN (SELECT * FROM pass WHERE k <= n) p USING (session, instrument, hr))
SELECT * FROM stages""",
)
def stage_labels(spark: SparkSession, sf: str) -> DataFrame:
    u = utilities(spark, sf)
    stages = {
        "entry": G.entry_stage(u), "direction": G.direction_stage(u), "market": G.market_direction_stage(u, 0.1), "market_all": G.market_direction_stage(u, 0.1, entered_only=False), "ce_win": G.side_win_stage(u, "ce", 0.02), "pe_win": G.side_win_stage(u, "pe", 0.02),
        "recipe": G.recipe_stage(u).withColumn("move_label", F.col("chosen_direction_up")), "direction_or_no_trade": G.direction_or_no_trade_stage(u, ["instrument"], ["session", "hr"], **_THRESHOLDS),
    }
    out = None
    for name, df in stages.items():
        side = F.col("first_hit_side") if "first_hit_side" in df.columns else F.lit(None).cast("string")
        part = df.select(F.lit(name).alias("stage"), *HOUR, F.col("move_label").cast("int").alias("move_label"), side.alias("side"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "lbl_11_conviction",
    "WITH " + UTIL + _CONVICTED.format(rows="util") + """ SELECT session, instrument, hr, round(edge, 6) AS edge, round(winner, 6) AS winner_return, round(conviction, 6) AS conviction, round(min(conviction) OVER (PARTITION BY instrument), 6) AS score_floor,
(SELECT count(*) FROM util WHERE edge < 0.05) AS edge_dropped, (SELECT count(*) FROM util WHERE edge >= 0.05 AND winner < 0.03) AS winner_dropped, (SELECT count(*) FROM util WHERE edge >= 0.05 AND winner >= 0.03 AND opposing > 0.5) AS opposing_dropped FROM pass WHERE k <= n""",
)
def conviction(spark: SparkSession, sf: str) -> DataFrame:
    rows, counts = G.convicted(utilities(spark, sf), ["instrument"], ["session", "hr"], **_THRESHOLDS)
    return rounded(rows.select(*HOUR, "edge", "winner_return", "conviction", "score_floor").crossJoin(counts.select("edge_dropped", "winner_dropped", "opposing_dropped")))


def _swing_sql(sign: int) -> str:
    stop, far, near = ("min(low)", "high", "min") if sign > 0 else ("max(high)", "low", "max")
    beyond, stopped, reached = (">", "low <= stop", "high >= target") if sign > 0 else ("<", "high >= stop", "low <= target")
    return f"""WITH {HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY session, instrument ORDER BY hr) AS rn FROM hourly),
e AS (SELECT session, instrument, hr, rn, close AS entry, {stop} OVER (PARTITION BY session, instrument ORDER BY hr ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS stop FROM n),
t AS (SELECT e.*, coalesce((SELECT {near}(x.{far}) FROM n x WHERE x.session = e.session AND x.instrument = e.instrument AND x.rn > e.rn AND x.rn <= e.rn + 6 AND x.{far} {beyond} e.entry), entry * (1 + {sign} * 0.005)) AS target FROM e),
p AS (SELECT t.session, t.instrument, t.hr, t.entry, t.stop, t.target, x.rn - t.rn AS k, x.close, {stopped} AS s, {reached} AS r FROM t LEFT JOIN n x ON x.session = t.session AND x.instrument = t.instrument AND x.rn > t.rn AND x.rn <= t.rn + 4),
g AS (SELECT session, instrument, hr, any_value(entry) AS entry, any_value(stop) AS stop, any_value(target) AS target, arg_min(s, k) FILTER (s OR r) AS was_stop, count(*) FILTER (s OR r) AS hits, arg_max(close, k) AS last FROM p GROUP BY ALL),
z AS (SELECT *, CASE WHEN hits = 0 THEN 'session_end' WHEN was_stop THEN 'stop_hit' ELSE 'target_hit' END AS exit_reason, CASE WHEN hits = 0 THEN coalesce(last, entry) WHEN was_stop THEN stop ELSE target END AS x FROM g)
SELECT session, instrument, hr, exit_reason, round(stop, 6) AS swing_stop, round(target, 6) AS swing_target, round(x, 6) AS swing_exit, round({sign} * 100 * (x - entry) / nullif(entry, 0), 6) AS swing_pnl FROM z"""


@query("lbl_13_swing_exit", _swing_sql(1))
def swing_exit(spark: SparkSession, sf: str) -> DataFrame:
    out = G.swing_exit(hourly(spark, sf), ["session", "instrument"], ["hr"], "high", "low", "close", 4, 3, 6)
    return rounded(out, *HOUR, "exit_reason", "swing_stop", "swing_target", "swing_exit", "swing_pnl")


@query("lbl_13_swing_exit_short", _swing_sql(-1))
def swing_exit_short(spark: SparkSession, sf: str) -> DataFrame:
    out = G.swing_exit(hourly(spark, sf), ["session", "instrument"], ["hr"], "high", "low", "close", 4, 3, 6, sign=-1)
    return rounded(out, *HOUR, "exit_reason", "swing_stop", "swing_target", "swing_exit", "swing_pnl")


@query(
    "fun_24_volatility_block",
    "WITH " + DAILY + """, v AS (SELECT instrument, session, CASE WHEN open > 20 THEN open END AS o, CASE WHEN close > 10 THEN close END AS c FROM daily), p AS (SELECT *, lag(c) OVER (PARTITION BY instrument ORDER BY session) AS prev FROM v),
x AS (SELECT *, coalesce(o, prev) AS op, coalesce(c, o, prev) AS cur FROM p) SELECT instrument, session, round(prev, 6) AS vix_prev_close, round(op, 6) AS vix_open, round(cur, 6) AS vix_current, round(100 * (cur - prev) / nullif(prev, 0), 6) AS vix_change_from_prev,
round(100 * (cur - op) / nullif(op, 0), 6) AS vix_intraday_chg, CASE WHEN cur < 14 THEN 'LOW' WHEN cur <= 20 THEN 'NORMAL' WHEN cur > 20 THEN 'ELEVATED' END AS vix_regime, coalesce(100 * (cur - op) / nullif(op, 0) > 15, false) AS vix_spike_flag FROM x""",
)
def volatility_block(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).select("instrument", "session", F.when(F.col("open") > 20, F.col("open")).alias("o"), F.when(F.col("close") > 10, F.col("close")).alias("c"))
    return rounded(G.volatility_block(d, ["instrument"], "session", "o", "c").drop("o", "c"))


@query(
    "joi_19_enriched_trades",
    "WITH " + TRADES + """, v AS (SELECT l_orderkey AS id, count(*) AS votes, count(*) FILTER (l_returnflag = 'R') AS ce_votes, count(*) FILTER (l_returnflag = 'N') AS pe_votes FROM lineitem GROUP BY 1)
SELECT t.id, coalesce(c_mktsegment, regime) AS regime, round(c_acctbal, 6) AS signal_confidence, coalesce(votes, 0) AS votes, coalesce(ce_votes, 0) AS ce_votes, coalesce(pe_votes, 0) AS pe_votes, CASE WHEN ret > 0 THEN 'WIN' WHEN ret < 0 THEN 'LOSS' ELSE 'FLAT' END AS result,
CASE exit_reason WHEN 'R' THEN 'stop' WHEN 'N' THEN 'time' ELSE CASE WHEN ret > 0 THEN 'win' WHEN ret < 0 THEN 'loss' ELSE 'unknown' END END AS actual_outcome
FROM trades t LEFT JOIN customer c ON c_custkey = cust LEFT JOIN v USING (id)""",
)
def enriched_trades(spark: SparkSession, sf: str) -> DataFrame:
    reasons = F.when(F.col("exit_reason") == "R", "stop_loss").when(F.col("exit_reason") == "N", "time_stop").otherwise(F.col("exit_reason"))
    t = trades(spark, sf).withColumns({"exit_reason": reasons, "signal_id": F.col("cust"), "snapshot_id": F.col("id")})
    signals = read(spark, sf, "customer").select(F.col("c_custkey").alias("signal_id"), F.col("c_mktsegment").alias("regime"), F.col("c_acctbal").alias("confidence"))
    votes = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.when(F.col("l_returnflag") == "R", "CE").when(F.col("l_returnflag") == "N", "PE").alias("vote"))
    return rounded(G.enriched_trades(t, signals, votes), "id", "regime", "signal_confidence", "votes", "ce_votes", "pe_votes", "result", "actual_outcome")
