"""Queries of trade reports, score quality, streams and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evaluate as E
from ..operators import learn as ML
from ..operators import scans as C
from ..sources import readers
from ..streaming import jobs as ST
from .catalogue import query, rounded
from .views import BARS, POSITIONS, SCORES, TRADES, bars, daily, positions, read, scores, trades

_SUMMARY = "count(*) AS trades, count(*) FILTER (ret > 0) AS wins, count(*) FILTER (ret < 0) AS losses, count(*) FILTER (ret = 0) AS flats, round(avg((ret > 0)::INT), 6) AS win_rate, round(avg(ret), 6) AS mean_return, round(median(ret), 6) AS median_return, round(coalesce(sum(ret) FILTER (ret > 0), 0), 6) AS gross_profit, round(coalesce(sum(ret) FILTER (ret < 0), 0), 6) AS gross_loss, round(sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0), 6) AS profit_factor"
_PICK = ("trades", "wins", "losses", "flats", "win_rate", "mean_return", "median_return", "gross_profit", "gross_loss", "profit_factor")


@query("agg_9_trade_reconstruction", "WITH " + POSITIONS + ", g AS (SELECT id, last(price ORDER BY ts, event_id) FILTER (event = 'OPEN') AS o, last(price ORDER BY ts, event_id) FILTER (event = 'CLOSE') AS c, count(*) AS events FROM pos GROUP BY id) SELECT id, round(o, 6) AS open_price, round(c, 6) AS close_price, events FROM g WHERE o IS NOT NULL AND c IS NOT NULL")
def reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.reconstruct(positions(spark, sf), "id", "event", ["ts", "event_id"], ["price"]), "id", "open_price", "close_price", "events")


@query("agg_10_11_15_trade_summary", "WITH " + TRADES + f" SELECT regime, side, {_SUMMARY}, round(avg(mfe), 6) AS avg_mfe, round(avg(bars_held), 6) AS avg_bars FROM trades GROUP BY ALL")
def trade_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.trade_summary(trades(spark, sf), ["regime", "side"], "ret", mfe="mfe", mae="mae", bars="bars_held"), "regime", "side", *_PICK, "avg_mfe", "avg_bars")


@query("agg_11_grouping_sets", "WITH " + TRADES + " SELECT regime, side, exit_reason, grouping(regime, side, exit_reason)::BIGINT AS grouping_id, count(*) AS trades, round(sum(ret), 6) AS net, round(avg((ret > 0)::INT), 6) AS win_rate FROM trades GROUP BY GROUPING SETS ((regime), (side), (exit_reason), ())")
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.summary_sets(trades(spark, sf), [["regime"], ["side"], ["exit_reason"], []], "ret"))


@query("agg_12_13_exit_breakdown", "WITH " + TRADES + " SELECT exit_reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM trades GROUP BY 1")
def exit_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.share_breakdown(trades(spark, sf), ["exit_reason"]))


@query("agg_13_stop_analysis", "WITH " + TRADES + " SELECT regime, count(*) AS trades, count(*) FILTER (exit_reason = 'R') AS stopped, round(avg((exit_reason = 'R')::INT), 6) AS stopped_share, count(*) FILTER (exit_reason = 'R' AND ret > 0) AS locked, round(avg(ret) FILTER (exit_reason = 'R' AND ret > 0), 6) AS avg_locked, round(avg(ret / mfe) FILTER (exit_reason = 'R' AND ret > 0 AND mfe > 0), 6) AS capture FROM trades GROUP BY 1")
def stop_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.stop_analysis(trades(spark, sf), ["regime"], "exit_reason", "ret", "mfe", ["R"]))


@query("agg_14_runs", "WITH " + TRADES + " SELECT cust, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (exit_reason = 'R') AS closed FROM trades GROUP BY 1 HAVING count(*) FILTER (exit_reason = 'R') > 0 ORDER BY last_day DESC, closed DESC, cust LIMIT 20")
def runs(spark: SparkSession, sf: str) -> DataFrame:
    return E.discover_runs(trades(spark, sf), "cust", "day", F.col("exit_reason") == "R", 20)


_GATED = BARS + ", t AS (SELECT user_id, session, list({'gate_id': instrument, 'status': CASE WHEN price > 60 THEN 'block' ELSE 'pass' END} ORDER BY ts, event_id) AS g, CASE WHEN count(*) > 2 THEN 'TRADE' ELSE 'HOLD' END AS outcome FROM bars GROUP BY ALL)"


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    gate = F.struct("ts", "event_id", F.struct(F.col("instrument").alias("gate_id"), F.when(F.col("price") > 60, "block").otherwise("pass").alias("status")).alias("g"))
    g = bars(spark, sf).groupBy("user_id", "session").agg(F.array_sort(F.collect_list(gate)).alias("a"), F.count("*").alias("n"))
    return g.select("user_id", "session", F.transform("a", lambda x: x["g"]).alias("gates"), F.when(F.col("n") > 2, "TRADE").otherwise("HOLD").alias("outcome"))


@query("agg_17_gate_funnel", "WITH " + _GATED + ", f AS (SELECT outcome, coalesce(list_filter(g, lambda x: x.status <> 'pass')[1].gate_id, 'passed') AS blocker FROM t) SELECT outcome, blocker, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, outcome, blocker LIMIT 8")
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    return E.gate_funnel(_gated(spark, sf), "gates", "outcome", 8)


@query("agg_18_gate_counts", "WITH " + BARS + " SELECT instrument AS gate_id, count(*) FILTER (NOT price > 60) AS passed, count(*) FILTER (price > 60) AS blocked FROM bars GROUP BY 1")
def gate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.gate_counts(_gated(spark, sf), "gates")


@query("agg_19_event_rollup", "WITH " + BARS + " SELECT instrument, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS runs FROM bars GROUP BY 1")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return E.event_rollup(bars(spark, sf), "instrument", "ts", "user_id")


@query("agg_20_evl_15_agreement", "WITH " + SCORES + ", x AS (SELECT lang, p, CASE WHEN p > 0.6 THEN 1 WHEN p < 0.4 THEN -1 ELSE 0 END AS pred, CASE WHEN y = 1 THEN 1 ELSE -1 END AS truth, CASE WHEN z = 1 THEN 1 ELSE -1 END AS other FROM scores) SELECT lang, count(*) AS rows, round(avg((pred <> 0)::INT), 6) AS commit_rate, round(avg((pred = other)::INT) FILTER (pred <> 0), 6) AS agree_rate, round(avg((pred = truth)::INT) FILTER (pred <> 0), 6) AS accuracy, round(avg(p), 6) AS mean_confidence FROM x GROUP BY lang")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    two = lambda c: F.when(F.col(c) == 1, 1).otherwise(-1)
    x = scores(spark, sf).withColumn("pred", F.when(F.col("p") > 0.6, 1).when(F.col("p") < 0.4, -1).otherwise(0)).withColumn("truth", two("y")).withColumn("other", two("z"))
    return rounded(E.agreement(x, ["lang"], "pred", "truth", "other", "p"))


@query("agg_21_leaderboard", "WITH " + TRADES + ", w AS (SELECT regime, year(day) AS yr, sum(ret) AS net, count(*) AS n FROM trades GROUP BY ALL) SELECT regime, count(DISTINCT yr) AS windows, round(sum(net), 6) AS total, round(avg(net), 6) AS mean, round(median(net), 6) AS median, round(avg((net > 0)::INT), 6) AS positive_share, round(min(net), 6) AS worst, sum(n)::BIGINT AS trades FROM w GROUP BY regime")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    w = trades(spark, sf).groupBy("regime", F.year("day").alias("yr")).agg(F.sum("ret").alias("net"), F.count("*").alias("n"))
    return rounded(E.leaderboard(w, "regime", "yr", "net", "n"))


@query("agg_22_segments", "WITH " + TRADES + ", s AS (SELECT unnest(['F', 'O', 'X']) AS side), g AS (SELECT side, count(*) AS n, sum(ret) AS net, sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0) AS pf FROM trades GROUP BY 1) SELECT side, coalesce(n, 0) AS rows, round(coalesce(n, 0) / (SELECT count(*) FROM trades), 6) AS share, round(coalesce(net, 0), 6) AS net, round(pf, 6) AS profit_factor FROM s LEFT JOIN g USING (side)")
def segments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.segment_report(trades(spark, sf), "side", ["F", "O", "X"], "ret"))


@query("agg_23_distribution_shift", "WITH a AS (SELECT lang, count(*) / sum(count(*)) OVER () AS s FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT lang, count(*) / sum(count(*)) OVER () AS s FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT lang, round(coalesce(a.s, 0), 6) AS share_a, round(coalesce(b.s, 0), 6) AS share_b, round(abs(coalesce(a.s, 0) - coalesce(b.s, 0)), 6) AS shift FROM a FULL JOIN b USING (lang)")
def distribution_shift(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "lang")
    return rounded(E.distribution_shift(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "lang"))


@query("agg_24_histogram", "WITH " + SCORES + " SELECT y, CASE WHEN p < 0.2 THEN 0 WHEN p < 0.5 THEN 1 WHEN p < 0.8 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM scores GROUP BY ALL")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return E.histogram(scores(spark, sf), "p", [0.0, 0.2, 0.5, 0.8, 1.0], ["y"])


@query("agg_25_26_quantiles", "WITH " + TRADES + ", r AS (SELECT regime, ret, row_number() OVER (PARTITION BY regime ORDER BY ret) AS i, count(*) OVER (PARTITION BY regime) AS n FROM trades), k AS (SELECT regime, max(ret) FILTER (i = ceil(n * 0.9)) AS q90 FROM r GROUP BY 1) SELECT regime, round(quantile_cont(ret, 0.05), 6) AS p05, round(quantile_cont(ret, 0.5), 6) AS p50, round(quantile_cont(ret, 0.95), 6) AS p95, round(stddev_pop(ret), 6) AS spread, round(any_value(q90), 6) AS q90 FROM trades JOIN k USING (regime) GROUP BY regime")
def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf)
    return rounded(E.quantiles(t, ["regime"], "ret").join(E.nearest_rank(t, ["regime"], "ret", [0.9]), "regime"), "regime", "p05", "p50", "p95", "spread", "q90")


@query("agg_27_column_profile", "SELECT 'quality' AS \"column\", count(*) AS rows, count(*) - count(quality) AS nulls, min(quality)::DOUBLE AS least, max(quality)::DOUBLE AS greatest, round(avg(quality), 6) AS mean, round(stddev_pop(quality), 6) AS spread FROM labels UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic), min(toxic), max(toxic), round(avg(toxic), 6), round(stddev_pop(toxic), 6) FROM labels")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.column_profile(read(spark, sf, "labels"), ["quality", "toxic"]), "column", "rows", "nulls", "least", "greatest", "mean", "spread")


@query("agg_28_30_daily_concentration", "WITH " + TRADES + ", d AS (SELECT day, round(sum(ret), 9) AS s FROM trades GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, day) AS b, row_number() OVER (ORDER BY s, day) AS w FROM d) SELECT count(*) AS days, round(sum(s), 5) AS net, round(sum(s) FILTER (b <= 5) / sum(s), 5) AS top5_share, round(sum(s) - sum(s) FILTER (b <= 5), 5) AS net_without_top5, round(sum(s) FILTER (w <= 5), 5) AS worst5, round(avg((s > 0)::INT), 5) AS profitable_days FROM r")
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    c = E.concentration(trades(spark, sf), "day", "ret")
    return c.select("days", *(F.round(x, 5).alias(x) for x in ("net", "top5_share", "net_without_top5", "worst5", "profitable_days")))


@query("agg_29_31_32_33_buckets", "WITH " + TRADES + " SELECT CAST(floor(bars_held / 10) AS BIGINT) AS bucket, count(*) AS trades, round(sum(ret), 6) AS net, round(avg((ret > 0)::INT), 6) AS win_rate, round(sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0), 6) AS profit_factor FROM trades GROUP BY 1 HAVING count(*) >= 100")
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.bucket_table(trades(spark, sf), F.floor(F.col("bars_held") / 10), "ret", 100))


@query("agg_33_pass_matrix", "WITH " + TRADES + ", g AS (SELECT year(day)::INTEGER AS yr, side, sum(ret) > 0 AS ok FROM trades GROUP BY ALL) SELECT yr, min(CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END) FILTER (side = 'F') AS F, min(CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END) FILTER (side = 'O') AS O FROM g GROUP BY yr")
def pass_matrix(spark: SparkSession, sf: str) -> DataFrame:
    g = trades(spark, sf).groupBy(F.year("day").alias("yr"), "side").agg((F.sum("ret") > 0).alias("ok"))
    return E.pass_matrix(g, "yr", "side", F.col("ok"), ["F", "O"])


# ---------------------------------------------------------------- scores


@query("evl_2_return_summary", "WITH " + TRADES + " SELECT regime, count(*) FILTER (bars_held > 20) AS trades, round(1 - avg((bars_held > 20)::INT), 6) AS block_rate, round(coalesce(sum(ret) FILTER (bars_held > 20), 0), 6) AS net, round(avg((ret > 0)::INT) FILTER (bars_held > 20), 6) AS win_rate FROM trades GROUP BY 1")
def return_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.return_summary(trades(spark, sf), ["regime"], "ret", F.col("bars_held") > 20, "side"), "regime", "trades", "block_rate", "net", "win_rate")


@query("evl_3_4_auc_brier", "WITH " + SCORES + ", r AS (SELECT lang, y, p, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS rk FROM scores) SELECT lang, count(*) AS rows, sum(y)::BIGINT AS positives, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc, round(avg((p - y) * (p - y)), 6) AS brier FROM r GROUP BY lang")
def auc_brier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.auc_brier(scores(spark, sf), "p", "y", ["lang"]))


@query("evl_5_6_16_calibration", "WITH " + SCORES + ", r AS (SELECT *, row_number() OVER (ORDER BY p, doc_id) - 1 AS i, count(*) OVER () AS n FROM scores), e AS (SELECT unnest(range(0, 10)) AS b), x AS (SELECT b, p, y FROM r JOIN e ON i >= floor(b * n / 10) AND i < floor((b + 1) * n / 10)) SELECT b::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS positive_share FROM x GROUP BY b")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.calibration(scores(spark, sf), "p", "y", ["doc_id"]))


@query("evl_6_calibration_error", "WITH " + SCORES + ", b AS (SELECT least(9, floor(p * 10)) AS b, count(*) AS n, avg(p) AS m, avg(y) AS s FROM scores GROUP BY 1) SELECT round(sum(n * abs(m - s)) / sum(n), 6) AS calibration_error FROM b")
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.calibration_error(scores(spark, sf), "p", "y", ["doc_id"], equal_count=False))


@query("evl_7_separation", "WITH " + SCORES + " SELECT round(avg(p) FILTER (y = 1) - avg(p) FILTER (y = 0), 6) AS mean_gap, round(median(p) FILTER (y = 1) - median(p) FILTER (y = 0), 6) AS median_gap, round(avg(p) FILTER (y = 1), 6) AS mean_positive, round(avg(p) FILTER (y = 0), 6) AS mean_negative FROM scores")
def separation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.separation(scores(spark, sf), "p", "y"))


@query("evl_8_fire_rates", "WITH " + SCORES + ", g AS (SELECT unnest([0.2, 0.5, 0.9]::DOUBLE[]) AS threshold) SELECT threshold, round(avg((p >= threshold)::INT), 6) AS fire_rate, round(avg(y) FILTER (p >= threshold), 6) AS precision, round(avg(y), 6) AS base_rate FROM scores, g GROUP BY 1")
def fire_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.fire_rates(scores(spark, sf), "p", "y", [0.2, 0.5, 0.9]))


@query("evl_9_17_actions_and_levels", "WITH " + SCORES + ", x AS (SELECT CASE WHEN p >= 0.6 AND p - (1 - p) >= 0.3 THEN 'CE' WHEN 1 - p >= 0.6 AND 1 - p - p >= 0.3 THEN 'PE' END AS side, y, p FROM scores) SELECT 'all' AS level, count(*) AS rows, 1.0::DOUBLE AS coverage, round(avg((side = 'CE')::INT), 6) AS long_share FROM x UNION ALL SELECT 'called', count(side), round(avg((side IS NOT NULL)::INT), 6), round(avg((side = 'CE')::INT) FILTER (side IS NOT NULL), 6) FROM x UNION ALL SELECT 'good', count(*) FILTER (side IS NOT NULL AND y = 1), round(avg((side IS NOT NULL AND y = 1)::INT), 6), round(avg((side = 'CE')::INT) FILTER (side IS NOT NULL AND y = 1), 6) FROM x")
def actions(spark: SparkSession, sf: str) -> DataFrame:
    x = scores(spark, sf).withColumn("q", 1 - F.col("p"))
    x = x.withColumn("side", E.direction_action("p", "q", 0.6, 0.3))
    made = F.col("side").isNotNull()
    return rounded(E.funnel_levels(x, "side", {"all": F.lit(True), "called": made, "good": made & (F.col("y") == 1)}))


@query("evl_11_t_statistic", "WITH " + TRADES + " SELECT regime, count(*) AS n, round(avg(ret), 6) AS mean, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 5) AS t FROM trades GROUP BY 1")
def t_statistic(spark: SparkSession, sf: str) -> DataFrame:
    return E.t_statistic(trades(spark, sf), ["regime"], "ret").select("regime", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query("evl_13_gates", "WITH " + TRADES + ", s AS (SELECT regime, count(*) AS trades, avg((ret > 0)::INT) AS w, sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0) AS pf FROM trades GROUP BY 1) SELECT regime, trades >= 100 AS enough, coalesce(pf >= 1.2, false) AS profitable, w >= 0.5 AS wins, trades >= 100 AND coalesce(pf >= 1.2, false) AND w >= 0.5 AS passed FROM s")
def gates(spark: SparkSession, sf: str) -> DataFrame:
    s = E.trade_summary(trades(spark, sf), ["regime"], "ret").select("regime", "trades", "win_rate", "profit_factor")
    return E.gates(s, {"enough": F.col("trades") >= 100, "profitable": F.col("profit_factor") >= 1.2, "wins": F.col("win_rate") >= 0.5}).select("regime", "enough", "profitable", "wins", "passed")


@query("evl_14_feature_separation", "WITH " + SCORES + ", f AS (SELECT y, 'p' AS feature, p AS v FROM scores UNION ALL SELECT y, 'n_chars', n_chars FROM scores) SELECT feature, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, round((avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / nullif(sqrt((var_pop(v) FILTER (y = 1) + var_pop(v) FILTER (y = 0)) / 2), 0), 5) AS cohens_d FROM f GROUP BY feature")
def feature_separation(spark: SparkSession, sf: str) -> DataFrame:
    return E.feature_separation(scores(spark, sf), ["p", "n_chars"], "y").select("feature", "n1", "n0", F.round("cohens_d", 5).alias("cohens_d"))


@query("evl_18_side_capture", "WITH " + SCORES + ", g AS (SELECT unnest([0.3, 0.7]::DOUBLE[]) AS threshold) SELECT threshold, lang, count(*) FILTER (p >= threshold) AS called, round(avg((y = 1)::INT) FILTER (p >= threshold), 6) AS precision, round(count(*) FILTER (p >= threshold AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 6) AS capture FROM scores, g GROUP BY ALL")
def side_capture(spark: SparkSession, sf: str) -> DataFrame:
    x = scores(spark, sf).withColumn("truth", F.when(F.col("y") == 1, F.col("lang")).otherwise("none"))
    return rounded(E.side_capture(x, "p", "lang", "truth", [0.3, 0.7]))


@query("evl_19_recent_quality", "WITH " + TRADES + ", d AS (SELECT DISTINCT day FROM trades ORDER BY day DESC LIMIT 30), x AS (SELECT *, bars_held / 50 AS p FROM trades WHERE day IN (SELECT day FROM d)) SELECT count(DISTINCT day) AS days, count(*) FILTER (p >= 0.5) AS trades, round(avg((ret > 0)::INT) FILTER (p >= 0.5), 6) AS precision, round(sum(ret) FILTER (p >= 0.5 AND ret > 0) / nullif(-sum(ret) FILTER (p >= 0.5 AND ret < 0), 0), 6) AS profit_factor, round(abs(avg(p) - avg((ret > 0)::INT)), 6) AS calibration_gap FROM x")
def recent_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.recent_quality(trades(spark, sf).withColumn("p", F.col("bars_held") / 50), "day", 30, "p", 0.5, "ret"))


@query("evl_20_ab_compare", "WITH " + TRADES + ", d AS (SELECT day FROM trades WHERE side = 'F' INTERSECT SELECT day FROM trades WHERE side = 'O') SELECT count(*) FILTER (side = 'F') AS trades_a, round(coalesce(sum(ret) FILTER (side = 'F'), 0), 6) AS net_a, count(*) FILTER (side = 'O') AS trades_b, round(coalesce(sum(ret) FILTER (side = 'O'), 0), 6) AS net_b, CASE WHEN sum(ret) FILTER (side = 'F') > sum(ret) FILTER (side = 'O') THEN 'a' ELSE 'b' END AS winner FROM trades WHERE day IN (SELECT day FROM d) AND side IN ('F', 'O')")
def ab_compare(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf)
    return rounded(E.ab_compare(t.where("side = 'F'"), t.where("side = 'O'"), "day", "ret"))


@query("scn_9_evl_21_daily_equity", "WITH " + TRADES + ", e AS (SELECT regime, day, id, ret, 100 + sum(ret) OVER (PARTITION BY regime ORDER BY day, id) AS q FROM trades) SELECT regime, day, count(*) AS trades, round(arg_max(q, id), 6) AS end_equity, round(max(ret), 6) AS best, round(min(ret), 6) AS worst FROM e GROUP BY regime, day")
def daily_equity(spark: SparkSession, sf: str) -> DataFrame:
    c = C.daily_equity(trades(spark, sf), "ret", "day", ["regime"], ["day", "id"], 100.0)
    return c.select("regime", "day", "trades", *(F.round(x, 6).alias(x) for x in ("end_equity", "best", "worst")))


# ---------------------------------------------------------------- streams


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return readers.stream(spark, f"{sf}/events*.parquet", spark.read.parquet(f"{sf}/events.parquet").schema)


@query("str_1_2_dedupe_envelopes", "SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def dedupe(spark: SparkSession, sf: str) -> DataFrame:
    raw = _stream(spark, sf).select(F.to_json(F.struct("user_id", F.col("ts").alias("at"), "props")).alias("value"))
    good, _ = ST.parsed(raw, "value", "user_id long, at timestamp, props string", ["user_id", "at"])
    keyed = good.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return ST.run_to_table(ST.deduplicated(keyed, "at", ["user_id", "k"], "60 days").select("user_id", "k"), "dedupe")


@query("str_7_tick_bars", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS bar_ts, event_type, round(first(value ORDER BY ts, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(last(value ORDER BY ts, event_id), 6) AS close, count(*) AS n FROM events WHERE value > 0 GROUP BY ALL")
def tick_bars(spark: SparkSession, sf: str) -> DataFrame:
    s = _stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    out = ST.run_to_table(ST.tick_bars(s, "at", ["event_type"], "value", "event_id", "30 minutes"), "ticks", "complete")
    return rounded(out.withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz")))


@query(
    "str_3_sliding_and_sessions",
    """WITH g AS (SELECT user_id, event_type, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 1 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, event_type, min(ts) AS first_ts, max(ts) + INTERVAL 1 HOUR AS end_ts, count(*) AS n FROM s GROUP BY user_id, event_type, i""",
)
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user and type, which end an hour after their last event."""
    s = _stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    out = ST.run_to_table(ST.sessions(s, "at", ["user_id", "event_type"], "1 hour"), "sessions", "complete")
    return out.select("user_id", "event_type", F.col("start").cast("timestamp_ntz").alias("first_ts"), F.col("end").cast("timestamp_ntz").alias("end_ts"), "n")


@query("str_3_sliding_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS first_ts, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL")
def sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of three-hour windows that begin every hour."""
    s = _stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    out = ST.run_to_table(ST.sliding_counts(s, "at", ["event_type"], "3 hours", "1 hour", "10 minutes"), "sliding", "complete")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("first_ts"), "n")


@query("str_5_upserted_stream", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def upserted_stream(spark: SparkSession, sf: str) -> DataFrame:
    return ST.run_upserts(_stream(spark, sf).select("user_id", "ts", "event_id"), "upserts", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("str_9_10_traces", "WITH " + BARS + " SELECT user_id || '-' || strftime(session, '%Y%m%d') AS trace, string_agg(instrument, '>' ORDER BY ts, event_id) AS path, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1")
def traces(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).withColumn("trace", F.concat_ws("-", "user_id", F.date_format("session", "yyyyMMdd"))).withColumn("payload", F.col("price").cast("string"))
    return ST.assembled_traces(b, "trace", "instrument", "ts", "payload").select("trace", "path", "first_ts", "last_ts")


@query("str_15_freshness", "WITH " + BARS + ", g AS (SELECT instrument, max(ts) AS latest, count(*) AS n FROM bars GROUP BY 1) SELECT instrument, latest, n, floor(epoch(max(latest) OVER ()))::BIGINT - floor(epoch(latest))::BIGINT AS age_seconds FROM g")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return ST.freshness(bars(spark, sf), "instrument", "ts")


@query("str_16_open_positions", "WITH " + POSITIONS + ", g AS (SELECT id, last(event ORDER BY ts, event_id) AS event, last(price ORDER BY ts, event_id) AS price FROM pos GROUP BY id) SELECT id, event, round(price, 6) AS price FROM g WHERE event <> 'CLOSE'")
def open_positions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ST.open_positions(positions(spark, sf), "id", "event", ["ts", "event_id"], ["price"]))


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    s = _stream(spark, sf)
    return s.select(F.col("event_type").alias("instrument"), F.date_format("ts", "yyyy-MM-dd").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), S.minute_of_day("ts").alias("minute"))


@query(
    "str_8_14_rolling_features",
    "WITH " + BARS + """, d AS (SELECT *, price - lag(price) OVER o AS d, CASE WHEN count(*) OVER f = 5 AND price = max(price) OVER f THEN price END AS ph, CASE WHEN count(*) OVER f = 5 AND price = min(price) OVER f THEN price END AS pl
  FROM bars WINDOW o AS (PARTITION BY session, instrument ORDER BY ts, event_id), f AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
p AS (SELECT *, list(price) OVER w AS v, list(greatest(d, 0.0)) FILTER (d IS NOT NULL) OVER w AS g, list(greatest(-d, 0.0)) FILTER (d IS NOT NULL) OVER w AS l, list(coalesce(abs(d), 0.0)) OVER w AS tr, max(price) OVER w AS h, min(price) OVER w AS lo,
  sum(price * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vw, row_number() OVER w AS bar, list(ph) FILTER (ph IS NOT NULL) OVER s AS hs, list(pl) FILTER (pl IS NOT NULL) OVER s AS ls
  FROM d WINDOW w AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY session, instrument ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
e AS (SELECT *, list_reduce(g, lambda y, x: y + (x - y) / 14) AS eg, list_reduce(l, lambda y, x: y + (x - y) / 14) AS el FROM p WHERE bar > 1)
SELECT p.instrument, p.event_id, round(list_reduce(p.v, lambda y, x: y * 0.8 + x * 0.2), 6) AS ema, round(p.h, 6) AS day_high, round(p.lo, 6) AS day_low, round(p.vw, 6) AS vwap, p.bar, round(list_reduce(p.tr, lambda y, x: y + (x - y) / 14), 6) AS atr,
  round(CASE WHEN p.bar > 14 AND e.el > 0 THEN 100 - 100 / (1 + e.eg / e.el) END, 6) AS rsi, CASE WHEN p.hs[-1] > p.hs[-2] AND p.ls[-1] > p.ls[-2] THEN 'HH_HL' WHEN p.hs[-1] < p.hs[-2] AND p.ls[-1] < p.ls[-2] THEN 'LH_LL' ELSE 'MIXED' END AS structure FROM p LEFT JOIN e USING (event_id)""",
)
def rolling_features(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.run_to_table(ST.rolling_features(_ticks(spark, sf).select("instrument", "session", "ts", "event_id", "price", "volume")), "features")
    return rounded(out, "instrument", "event_id", "ema", "day_high", "day_low", "vwap", "bar", "atr", "rsi", "structure")


@query(
    "str_11_cutoff_enrichment",
    "WITH " + BARS + """, m AS (SELECT instrument, session, count(*) AS n, last(price ORDER BY ts, event_id) - first(price ORDER BY ts, event_id) AS c, max(price) - min(price) AS r FROM bars WHERE hour(ts) * 60 + minute(ts) BETWEEN 600 AND 689 GROUP BY ALL)
SELECT b.instrument, b.event_id, CASE WHEN hour(ts) * 60 + minute(ts) >= 690 THEN m.n END AS morning_rows, round(CASE WHEN hour(ts) * 60 + minute(ts) >= 690 THEN m.c END, 6) AS morning_change, round(CASE WHEN hour(ts) * 60 + minute(ts) >= 690 THEN m.r END, 6) AS morning_range FROM bars b LEFT JOIN m USING (instrument, session)""",
)
def cutoff_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.run_to_table(ST.cutoff_enriched(_ticks(spark, sf).select("instrument", "session", "ts", "event_id", "minute", "price"), 600, 690), "cutoff")
    return rounded(out, "instrument", "event_id", "morning_rows", "morning_change", "morning_range")


# ---------------------------------------------------------------- models


@query("mlj_1_clipped", "WITH " + TRADES + ", b AS (SELECT quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM trades) SELECT id, round(greatest(least(ret, hi), lo), 6) AS ret FROM trades, b")
def clipped(spark: SparkSession, sf: str) -> DataFrame:
    t = trades(spark, sf).select("id", "ret")
    return rounded(ML.clipped(t, ML.clip_bounds(t, ["ret"]), ["ret"]))


@query("mlj_2_to_6_walk_forward")
def model_walk(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier for next-day rises, trained and scored fold by fold; quality per fold."""
    w = F.lead("close").over(Window.partitionBy("instrument").orderBy("session"))
    d = daily(spark, sf).withColumn("label", (w > F.col("close")).cast("double")).where("label is not null")
    d = d.withColumns({"range_": F.col("high") - F.col("low"), "place": S.safe_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), "vol": F.col("volume").cast("double")})
    s = ML.walk_forward_scores(d.select("instrument", "session", "range_", "place", "vol", "label"), "session", ["range_", "place", "vol"], "label", 14, 3, 4, 4)
    return rounded(ML.fold_quality(s, "label"))
