"""Training over time, trade utility and rule trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import learn as ML
from ..operators import training as TR
from ..operators.exits import Exits, rule_trades
from ..sources.writers import stored
from .catalogue import query, rounded
from .views import KEYS, NUMBERED, ORDER, bars, daily, trades

OBJECTIVE = TR.TradingObjective(0.55, 0.6, 0.04, 0.03, 0.001, True, 0.02, 30, 0.8, 0.9)
_STORED = """s AS (SELECT o_orderkey AS id, ((month(o_orderdate) - 1) // 2)::BIGINT AS fold, CAST(o_orderdate AS DATE) AS day, (o_orderkey * 37 % 101) / 100.0 AS ce_prob, (o_custkey * 53 % 101) / 100.0 AS pe_prob,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'tp' WHEN '2-HIGH' THEN 'SL' WHEN '3-MEDIUM' THEN 'time_stop' WHEN '4-NOT SPECIFIED' THEN 'tp_sl_same_bar' END AS ce_path_exit_reason,
  CASE o_orderstatus WHEN 'F' THEN 'sl' WHEN 'O' THEN 'tp' END AS pe_path_exit_reason, (o_totalprice % 1000 - 500) / 5000 AS ce_forward_return, (o_totalprice % 700 - 350) / 5000 AS pe_forward_return FROM orders)"""
_MEASURES = """count(net) AS trades, round(coalesce(sum(net), 0), 6) AS net_return_sum, round(coalesce(avg(net), 0), 6) AS mean_net_return,
  round(CASE WHEN count(net) = 0 THEN 0 WHEN coalesce(sum(net) FILTER (net < 0), 0) = 0 THEN CASE WHEN sum(net) > 0 THEN 999 ELSE 0 END ELSE coalesce(sum(net) FILTER (net > 0), 0) / -sum(net) FILTER (net < 0) END, 6) AS profit_factor,
  round(coalesce(avg((net > 0)::INT), 0), 6) AS win_rate, round(coalesce(max(dd), 0), 6) AS max_drawdown"""


def stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows of a score table of two sides, with the reasons and returns of their paths, in six folds by month."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    ce = F.create_map(*(F.lit(x) for x in ("1-URGENT", "tp", "2-HIGH", "SL", "3-MEDIUM", "time_stop", "4-NOT SPECIFIED", "tp_sl_same_bar")))
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.floor((F.month("o_orderdate") - 1) / 2).cast("long").alias("fold"), F.to_date("o_orderdate").alias("day"),
        (F.col("o_orderkey") * 37 % 101 / 100).alias("ce_prob"), (F.col("o_custkey") * 53 % 101 / 100).alias("pe_prob"), ce[F.col("o_orderpriority")].alias("ce_path_exit_reason"),
        F.when(F.col("o_orderstatus") == "F", "sl").when(F.col("o_orderstatus") == "O", "tp").alias("pe_path_exit_reason"),
        ((F.col("o_totalprice") % 1000 - 500) / 5000).alias("ce_forward_return"), ((F.col("o_totalprice") % 700 - 350) / 5000).alias("pe_forward_return"),
    )
    return stored(rows, "scores")


@query(
    "mlj_6_trade_utility",
    "WITH " + _STORED + f""", side AS (SELECT *, CASE WHEN ce_prob >= 0.55 AND pe_prob >= 0.6 THEN CASE WHEN ce_prob >= pe_prob THEN 'CE' ELSE 'PE' END WHEN ce_prob >= 0.55 THEN 'CE' WHEN pe_prob >= 0.6 THEN 'PE' END AS side FROM s),
g AS (SELECT id, fold, day, lower(CASE side WHEN 'CE' THEN ce_path_exit_reason ELSE pe_path_exit_reason END) AS reason, CASE side WHEN 'CE' THEN ce_forward_return ELSE pe_forward_return END AS forward FROM side WHERE side IS NOT NULL),
t AS (SELECT id, fold, day, CASE WHEN reason IN ('tp', 'tp_sl_same_bar') THEN 0.04 WHEN reason = 'sl' THEN -0.03 ELSE forward END - 0.001 AS net, ln(1 + greatest((CASE WHEN reason IN ('tp', 'tp_sl_same_bar') THEN 0.04 WHEN reason = 'sl' THEN -0.03 ELSE forward END - 0.001) * (0.02 / 0.03), -0.99)) AS x
  FROM g WHERE coalesce(reason, '') <> 'time_stop'),
p AS (SELECT *, sum(x) OVER (PARTITION BY fold ORDER BY day, id) AS pf, sum(x) OVER (ORDER BY fold, day, id) AS pa FROM t),
e AS (SELECT *, exp(pf + greatest(0, max(ln(1e-9) - pf) OVER (PARTITION BY fold ORDER BY day, id))) AS ef, exp(pa + greatest(0, max(ln(1e-9) - pa) OVER (ORDER BY fold, day, id))) AS ea FROM p),
d AS (SELECT *, 1 - ef / greatest(1, max(ef) OVER (PARTITION BY fold ORDER BY day, id)) AS df, 1 - ea / greatest(1, max(ea) OVER (ORDER BY fold, day, id)) AS da FROM e)
SELECT fold, {_MEASURES}, NULL::BOOLEAN AS constraints_pass FROM (SELECT DISTINCT fold FROM s) LEFT JOIN (SELECT fold, net, df AS dd FROM d) USING (fold) GROUP BY fold
UNION ALL SELECT *, trades >= 30 AND profit_factor >= 0.8 AND max_drawdown <= 0.9 FROM (SELECT NULL::BIGINT AS fold, {_MEASURES} FROM (SELECT net, da AS dd FROM d))""",
)
def utility(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(TR.trade_utility(stored_scores(spark, sf), "fold", ["day", "id"], OBJECTIVE))


@query(
    "scn_8_risk_scaled_drawdown",
    """WITH """ + """t AS (SELECT o_orderkey AS id, o_orderpriority AS regime, year(o_orderdate)::BIGINT AS yr, CAST(o_orderdate AS DATE) AS day, (o_totalprice % 1000 - 500) / 500 AS ret FROM orders),
p AS (SELECT *, sum(ln(1 + greatest(ret * 0.9, -0.99))) OVER (PARTITION BY regime ORDER BY yr, day, id) AS p FROM t), e AS (SELECT *, exp(p + greatest(0, max(ln(1e-9) - p) OVER (PARTITION BY regime ORDER BY yr, day, id))) AS e FROM p)
SELECT regime, round(max(d), 6) AS max_drawdown FROM (SELECT regime, 1 - e / greatest(1, max(e) OVER (PARTITION BY regime ORDER BY yr, day, id)) AS d FROM e) GROUP BY regime""",
)
def risk_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    """Wild trades, so that the floor of the equity is reached; years are the blocks."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    t = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("regime"), F.year("o_orderdate").cast("long").alias("yr"), F.to_date("o_orderdate").alias("day"), ((F.col("o_totalprice") % 1000 - 500) / 500).alias("ret"))
    return rounded(TR.scaled_drawdown(t, "ret", ["regime"], "yr", ["day", "id"], 0.9))


@query("mlj_2_5_purged_training")
def purged_training(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression and boosted trees for next-day rises, each label's interval purged from the folds; the leaderboard."""
    w = Window.partitionBy("instrument").orderBy("session")
    d = daily(spark, sf).withColumns({"label": (F.lead("close").over(w) > F.col("close")).cast("double"), "until": F.lead("session").over(w)}).where("label is not null")
    d = d.withColumns({"range_": F.col("high") - F.col("low"), "place": S.safe_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), "vol": F.col("volume").cast("double")})
    rows = stored(d.select("instrument", "session", F.col("session").cast("timestamp").alias("at"), F.col("until").cast("timestamp").alias("until"), "range_", "place", "vol", "label"), "daily-rows")
    return rounded(TR.edge_verdict(TR.walk_forward_training(rows, "session", "at", "until", ["range_", "place", "vol"], "label", 14, 3, 4, 4).leaderboard))


@query(
    "mlj_1_clipper_estimator",
    """WITH o AS (SELECT o_orderkey AS id, o_totalprice AS a, o_totalprice % 977 AS b FROM orders), q AS (SELECT quantile_cont(a, 0.02) AS al, quantile_cont(a, 0.9) AS ah, quantile_cont(b, 0.02) AS bl, quantile_cont(b, 0.9) AS bh FROM o)
SELECT id, round(greatest(least(a, ah), al), 6) AS a, round(greatest(least(b, bh), bl), 6) AS b FROM o, q""",
)
def clipper(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"), (F.col("o_totalprice") % 977).alias("b"))
    return rounded(TR.QuantileClipper(inputCols=["a", "b"], lower=0.02, upper=0.9).fit(o).transform(o))


_RULE = Exits(stop=0.5, target=1.0, time_stop=12, day_end=400, trail_arm=0.6, trail_back=0.3, underlying_stop=0.35)


@query(
    "lbl_12_rule_trades",
    "WITH RECURSIVE " + NUMBERED + """, r AS (SELECT session, instrument, rn, price AS p, (volume + 50)::DOUBLE AS u, coalesce(price < lag(price) OVER w, false) AND price > 0 AS s, coalesce(volume >= 95, false) AS x,
  rn = max(rn) OVER (PARTITION BY session, instrument) AS fin FROM b WINDOW w AS (PARTITION BY session, instrument ORDER BY rn)),
g AS (SELECT e.session, e.instrument, e.rn AS em, e.p AS ep, e.u AS eu, n.rn, n.p, n.u, n.x, n.fin, (n.p - e.p) / e.p AS g FROM r e JOIN r n ON n.session = e.session AND n.instrument = e.instrument AND n.rn BETWEEN e.rn + 1 AND e.rn + 12 WHERE e.s),
m AS (SELECT *, greatest(0, max(g) OVER w) AS mfe, least(0, min(g) OVER w) AS mae FROM g WINDOW w AS (PARTITION BY session, instrument, em ORDER BY rn)),
y AS (SELECT *, CASE WHEN g IS NOT NULL AND eu > 0 AND (u - eu) / eu < -0.35 THEN 'underlying_stop' WHEN g <= -0.5 THEN 'stop_loss' WHEN g >= 1.0 THEN 'target' WHEN mfe >= 0.6 AND g <= mfe - 0.3 THEN 'trail_stop' WHEN g IS NOT NULL AND x THEN 'signal'
      WHEN rn - em >= 12 THEN 'time_stop' WHEN rn >= 400 OR fin THEN 'eod_force' END AS why FROM m),
h AS (SELECT *, row_number() OVER (PARTITION BY session, instrument, em ORDER BY rn) AS place FROM y WHERE why IS NOT NULL),
t AS (SELECT session, instrument, em, rn AS xm, ep, p AS xp, (p - ep) / ep - 0.0002 AS net, why, mfe, mae FROM h WHERE place = 1 AND p > 0
  UNION ALL SELECT session, instrument, rn, rn, p, p, -0.0002, 'eod_force', 0, 0 FROM r WHERE s AND fin),
c AS (SELECT a.*, n.em AS next FROM t a ASOF LEFT JOIN t n ON n.session = a.session AND n.instrument = a.instrument AND n.em >= a.xm),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, instrument ORDER BY em) AS k FROM c) WHERE k = 1
  UNION ALL SELECT c.*, z.k + 1 FROM z JOIN c ON c.session = z.session AND c.instrument = z.instrument AND c.em = z.next AND z.em < z.xm)
SELECT session, instrument, em AS entry_minute, xm AS exit_minute, round(ep, 6) AS entry_price, round(xp, 6) AS exit_price, round(net, 6) AS net, why AS exit_reason, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM z""",
)
def trades_of_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Enter when the price falls; volume stands for the underlying, and high volume is the signal to leave.  A trade that ends without a
    price above 0 is none."""
    w = Window.partitionBy(*KEYS).orderBy(*ORDER)
    b = bars(spark, sf).withColumns({"rn": F.row_number().over(w), "before": F.lag("price").over(w), "under": F.col("volume") + 50.0})
    return rounded(rule_trades(b, KEYS, "rn", "price", F.col("price") < F.col("before"), _RULE, "under", F.col("volume") >= 95))


@query("mlj_4_gated_scores", "WITH " + _STORED + " SELECT id, round(ce_prob * pe_prob, 6) AS up, round(ce_prob * (1 - pe_prob), 6) AS down FROM s")
def gated_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The stored scores as those of a gate and of a direction: probabilities of moves up and down."""
    return rounded(stored_scores(spark, sf).select("id", ML.gated("ce_prob", "pe_prob").alias("x")).select("id", "x.*"))
