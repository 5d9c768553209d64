"""Clipper, purge, walk-forward, trade utility and rule trades against plain Python."""

import datetime as dt
import math
import random
import time

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tickloom.operators import training as TR
from tickloom.operators.exits import Exits, rule_trades
from tickloom.sources.writers import scratch

T0 = dt.datetime(2024, 1, 1)


def test_clipper_is_saved_and_loaded_in_a_pipeline(spark):
    rows = [(float(i), float("nan") if i % 7 == 0 else float(i * i), None if i % 2 else float("inf")) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    pipe = Pipeline(stages=[TR.QuantileClipper(inputCols=["a", "b", "c"], lower=0.1, upper=0.8), VectorAssembler(inputCols=["a"], outputCol="v")])
    model, path = pipe.fit(df), scratch(spark, "clipper")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, model.transform(df).collect()))
    out = again.transform(df).agg(F.min("a"), F.max("a"), F.count("b"), F.count("c")).first()
    assert tuple(out) == (pytest.approx(19.9), pytest.approx(159.2), 171, 0)
    pipe.write().overwrite().save(path + "-e")
    assert Pipeline.load(path + "-e").getStages()[0].getOrDefault("lower") == 0.1
    assert again.stages[0].transform(df.drop("b")).columns == ["a", "c"]


def test_no_train_interval_meets_a_held_out_one(spark):
    rng = random.Random(1)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    train = [(i, at(m := rng.randrange(1000)), at(m + rng.randrange(60)) if i % 5 else None) for i in range(300)] + [(999, None, at(5))]
    held = [(at(m := rng.randrange(600, 700)), at(m + rng.randrange(40))) for _ in range(20)]
    df = spark.createDataFrame(train, "id int, ts timestamp, until timestamp")
    kept = {r.id for r in TR.event_purged(df, spark.createDataFrame(held, "ts timestamp, until timestamp"), "ts", "until").collect()}
    want = {i for i, s, e in train if s is not None and not any(s <= b and (e or s) >= a for a, b in held)}
    assert kept == want and 0 < len(kept) < 290
    first = min(a for a, _ in held)
    times = sorted(s for _, s, _ in train if s is not None)
    gaps = sorted((b - a).total_seconds() for a, b in zip(times[:-1], times[1:], strict=True))
    step = (gaps[len(gaps) // 2] + gaps[(len(gaps) - 1) // 2]) / 2 or 60.0
    assert TR.median_step(df, "ts") == step
    kept = {r.id for r in TR.event_purged(df, spark.createDataFrame(held, "ts timestamp, until timestamp"), "ts", "until", 5).collect()}
    assert kept == {i for i, s, e in train if i in want and (e or s) < first - dt.timedelta(seconds=5 * step)}
    assert TR.event_purged(df, spark.createDataFrame([], "ts timestamp, until timestamp"), "ts", "until", 3).count() == 300


def test_walk_forward_fits_purged_folds_and_refits(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for d in range(12):
        for i in range(40):
            x = rng.gauss(0, 1)
            at = T0 + dt.timedelta(days=d, minutes=30 * i)
            rows.append((at.date(), at, at + dt.timedelta(hours=10), x, rng.gauss(0, 1) if i % 9 else None, float(x + rng.gauss(0, 0.7) > 0), 5.0))
    df = spark.createDataFrame(rows, "day date, ts timestamp, until timestamp, a double, b double, label double, p double")
    seen = []
    purge = TR.event_purged
    monkeypatch.setattr(TR, "event_purged", lambda train, held, *a: seen.append((out := purge(train, held, *a), held)) or out)
    w = TR.walk_forward_training(df, "day", "ts", "until", ["a", "b"], "label", 6, 2, 2, 2)
    assert len(seen) == 4  # two candidates, two folds
    for train, held in seen:
        assert train.agg(F.max("until")).first()[0] < held.agg(F.min("ts")).first()[0] and train.count() < 240
    assert w.scores.count() == 2 * 2 * 80 and w.scores.where("p < 0 or p > 1").count() == 0
    board = {r.candidate: r for r in w.leaderboard.collect()}
    assert set(board) == {"gbt", "logistic"} and all(r.folds == 2 and r.auc_mean > 0.7 for r in board.values()) and w.best == max(board, key=lambda c: board[c].auc_mean)
    path = scratch(spark, "best")
    w.model.save(path)
    again = TR.predicted(PipelineModel.load(path), df)
    assert again.columns == [*(c for c in df.columns if c != "p"), "p"] and again.where("a > 2").agg(F.min("p")).first()[0] > 0.5
    assert sorted(map(str, again.select("ts", "a").collect())) == sorted(map(str, df.select("ts", "a").collect()))
    with pytest.raises(ValueError):
        TR.walk_forward_training(df, "day", "ts", "until", ["a"], "label", 30, 2, 2, 2)


def plain_utility(rows, o):
    """rows: fold, at, ce, pe, reasons and returns of both sides, in order."""

    def drawdown(nets):
        scale, equity, peak, worst = o.risk_per_trade_pct / o.stop_loss_pct, 1.0, 1.0, 0.0
        for v in nets:
            equity = max(equity * (1 + max(v * scale, -0.99)), 1e-9)
            peak = max(peak, equity)
            worst = min(worst, equity / peak - 1)
        return -worst

    def measures(nets):
        gain, loss = sum(x for x in nets if x > 0), -sum(x for x in nets if x < 0)
        pf = gain / loss if loss else 999.0 if gain > 0 else 0.0
        return len(nets), sum(nets), sum(nets) / len(nets) if nets else 0.0, pf, sum(x > 0 for x in nets) / len(nets) if nets else 0.0, drawdown(nets)

    nets = {f: [] for f, *_ in rows}
    for f, _, ce, pe, cr, pr, cv, pv, cx, px in rows:
        up, down = ce is not None and ce >= o.ce_threshold, pe is not None and pe >= o.pe_threshold
        if not up and not down:
            continue
        side = ("ce" if ce >= pe else "pe") if up and down else "ce" if up else "pe"
        reason, forward, real = (cr, cv, cx) if side == "ce" else (pr, pv, px)
        reason = (reason or "").strip().lower()
        if reason == "time_stop" and o.discard_time_stop:
            continue
        gross = real if real is not None and math.isfinite(real) else o.take_profit_pct if reason in ("tp", "tp_sl_same_bar") else -o.stop_loss_pct if reason == "sl" else forward
        if gross is not None:
            nets[f].append(gross - o.cost_per_trade)
    return {**{f: measures(n) for f, n in nets.items()}, None: measures([x for f in sorted(nets) for x in nets[f]])}


@pytest.mark.parametrize("wild", [False, True])
def test_trade_utility_equals_a_plain_walk(spark, wild):
    rng = random.Random(3)
    size = 1.5 if wild else 0.05
    rows = [
        (f, i, rng.choice([None, rng.random(), rng.random()]) if f != 2 else 0.1, rng.random() if f != 2 else 0.0, *(rng.choice(["tp", " SL", "time_stop", None, "x", "tp_sl_same_bar"]) for _ in range(2)),
         *(rng.choice([None, rng.gauss(0, size), rng.gauss(0, size)]) for _ in range(2)), *(rng.choice([None, None, float("nan"), rng.gauss(0, size)]) for _ in range(2)))
        for f in range(4) for i in range(80)
    ]
    df = spark.createDataFrame(rows, "fold long, at int, ce_prob double, pe_prob double, ce_path_exit_reason string, pe_path_exit_reason string, ce_forward_return double, pe_forward_return double, ce_realized_return double, pe_realized_return double")
    for discard in (True, False):
        o = TR.TradingObjective(0.5, 0.6, 0.04, 0.03, 0.001, discard, 0.9 if wild else 0.02, 10, 0.5, 0.9)
        want = plain_utility(rows, o)
        got = {r.fold: r for r in TR.trade_utility(df, "fold", ["at"], o).collect()}
        assert set(got) == set(want)
        for f, w in want.items():
            r = got[f]
            assert (r.trades, r.net_return_sum, r.mean_net_return, r.profit_factor, r.win_rate, r.max_drawdown) == pytest.approx(w, rel=1e-6, abs=1e-9)
        n, _, _, pf, _, dd = want[None]
        assert got[None].constraints_pass == (n >= 10 and pf >= 0.5 and dd <= 0.9) and got[2].trades == 0 and got[0].constraints_pass is None


def plain_trades(rows, x):
    """rows of a day: minute, price, underlying, signal, leave."""
    out, free = [], 0
    for i, (m, p, u, s, _) in enumerate(rows):
        if i < free or not s or p is None or p <= 0:
            continue
        mfe = mae = 0.0
        end = (i, "eod_force")
        for j in range(i + 1, len(rows)):
            m2, p2, u2, _, go = rows[j]
            end, gain = (j, "eod_force"), None
            if p2 is not None:
                gain = x.sign * (p2 - p) / p
                mfe, mae = max(mfe, gain), min(mae, gain)
                under = x.underlying_stop is not None and u is not None and u2 is not None and u > 0 and x.sign * (u2 - u) / u < -x.underlying_stop
                why = "underlying_stop" if under else "stop_loss" if gain <= -x.stop else "target" if gain >= x.target else "trail_stop" if x.trail_arm is not None and mfe >= x.trail_arm and gain <= mfe - x.trail_back else "signal" if go else None
                if why:
                    end = (j, why)
                    break
            if m2 - m >= x.time_stop:
                end = (j, "time_stop")
                break
            if m2 >= x.day_end:
                break
        j, why = end
        if rows[j][1] is None or rows[j][1] <= 0:
            continue
        out.append((m, rows[j][0], p, rows[j][1], (x.sign * (rows[j][1] - p) / p if j > i else 0.0) - x.cost, why, mfe, mae))
        free = j if j > i else i + 1
    return out


@pytest.mark.parametrize("sign", [1, -1])
def test_rule_trades_equal_a_plain_walk(spark, sign):
    rng = random.Random(4)
    days, x = {}, Exits(0.3, 0.5, 15, 70, 0.2, 0.15, 0.1, sign)
    for d in range(60):
        price, rows = 100.0, []
        for m in range(rng.randrange(1, 90)):
            price = max(price * (1 + rng.gauss(0, 0.12)), 0.5)
            rows.append((m, None if rng.random() < 0.15 else price, rng.choice([None, 100 + rng.gauss(0, 4)]), rng.random() < 0.3, rng.random() < 0.05))
        days[f"d{d}"] = rows
    df = spark.createDataFrame([(d, *r) for d, rows in days.items() for r in rows], "day string, m int, p double, u double, s boolean, go boolean").repartition(3)
    got = rule_trades(df, ["day"], "m", "p", F.col("s"), x, "u", F.col("go"))
    want = sorted((d, *t) for d, rows in days.items() for t in plain_trades(rows, x))
    have = sorted(map(tuple, got.collect()))
    assert [(r[:3], r[6]) for r in have] == [(r[:3], r[6]) for r in want] and len({r[6] for r in want}) == 7
    for a, b in zip(have, want, strict=True):
        assert a[3:6] + a[7:] == pytest.approx(b[3:6] + b[7:])
    assert rule_trades(df.limit(0), ["day"], "m", "p", F.col("s"), x).count() == 0


def test_velocity_features_of_few_rows_nulls_and_adx(spark):
    import pandas as pd

    from tickloom.operators.velocity import velocity_features

    rng = random.Random(8)
    rows, x = [], 100.0
    for i in range(30):
        x += rng.gauss(0, 2)
        rows.append(("a", i, T0 + dt.timedelta(minutes=3 * i), x, x + rng.random(), x - rng.random(), x + rng.gauss(0, 0.3)))
    few = [("b", i, T0 + dt.timedelta(minutes=i), 1.0, 2.0, 0.5, 1.0) for i in range(2)]
    df = spark.createDataFrame(rows + few, "k string, i int, at timestamp, open double, high double, low double, close double")
    cut = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=90), None, 99.0, None), ("b", T0, 1.0, 1.0, 1.0), ("c", T0, 1.0, 1.0, 1.0)], "k string, at timestamp, close double, prev_close double, prev_volume double")
    got = {r.k: r.asDict() for r in velocity_features(df, cut, ["k"], "at", ["i"]).collect()}
    assert len(got["a"]) == 42 and all(v is None for k in "bc" for n, v in got[k].items() if n != "k")
    f = pd.DataFrame(rows, columns=["k", "i", "at", "open", "high", "low", "close"])
    up, down, pc = f.high.diff(), -f.low.diff(), f.close.shift(1)
    smooth = lambda s: s.ewm(alpha=1 / 14, adjust=False).mean()
    atr = smooth(pd.concat([f.high - f.low, (f.high - pc).abs(), (f.low - pc).abs()], axis=1).max(axis=1))
    plus, minus = (100 * smooth(s) / atr for s in (up.where((up > down) & (up > 0), 0.0).fillna(0.0), down.where((down > up) & (down > 0), 0.0).fillna(0.0)))
    adx = smooth(100 * (plus - minus).abs() / (plus + minus).replace(0.0, float("nan")))
    assert got["a"]["adx_14"] == pytest.approx(adx.dropna().iloc[-1])
    assert got["a"]["vel_price_delta_open"] == pytest.approx(f.close.iloc[-1] - f.open.iloc[0]) and got["a"]["ctx_am_gap_from_yday"] == pytest.approx(f.open.iloc[0] - 99.0)
    assert got["a"]["vel_ce_oi_delta_open"] is None and got["a"]["ctx_am_vol_vs_yday"] is None and got["a"]["ctx_am_breakout_confirmed"] == 0.0


def test_rule_trades_that_end_at_a_price_of_zero_are_none_in_the_sql_too(spark, tmp_path):
    from tests.compare import canonical, tables
    from tickloom.plans import catalogue, training_queries  # noqa: F401

    px = [10.0, 5.0, 0.0, 8.0, 6.0, 20.0, None, 9.0, 8.0, 7.0, 6.9, 6.8, 0.0]
    rows = [(i, dt.datetime(2024, 1, 1, 9, i), 1, "view", x, '{"k": 50}') for i, x in enumerate(px)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "made"))
    sf = tmp_path / "sf"
    sf.mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(sf / "events.parquet")
    out = catalogue.QUERIES["lbl_12_rule_trades"](spark, str(sf))
    got = [tuple(r) for r in out.collect()]
    assert [(r.entry_minute, r.exit_minute, r.exit_reason) for r in out.orderBy("entry_minute").collect()] == [(5, 6, "target")]
    rel = tables(str(sf)).sql(catalogue.ORACLE["lbl_12_rule_trades"])
    assert canonical(out.columns, got) == canonical(rel.columns, rel.fetchall())


def test_walk_forward_makes_its_rows_once(spark):
    from tickloom.operators import learn as ML

    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (made.add(1), x)[1], "double")
    rows = [(T0.date() + dt.timedelta(days=d), float((7 * d + 3 * i) % 11), float((d + i) % 2)) for d in range(12) for i in range(5)]
    df = spark.createDataFrame(rows, "day date, a double, label double").withColumn("a", seen("a"))
    assert ML.walk_forward_scores(df, "day", ["a"], "label", 4, 1, 2, 4).count() > 0 and made.value == len(rows)


@pytest.mark.parametrize("sign", [1, -1])
def test_rule_trades_held_for_long_equal_a_plain_walk(spark, sign):
    rng = random.Random(9)
    days, x = {}, Exits(0.6, 0.8, 150, 500, 0.5, 0.25, 0.3, sign)
    for d in range(24):
        price, rows, m = 100.0, [], 0
        for _ in range(rng.choice([1, 15, 16, 17, 18, 33, 600])):
            price, m = max(price * (1 + rng.gauss(0, 0.03)), 0.5), m + rng.choice([1, 1, 2])
            rows.append((m, rng.choice([None] * 9 + [0.0]) if rng.random() < 0.03 else price, rng.choice([None, 0.0, 100 + rng.gauss(0, 9)]), rng.random() < 0.4, rng.random() < 0.004))
        days[f"d{d}"] = rows[:-1] + [(m, None, *rows[-1][2:])] if d % 4 == 0 else rows
    df = spark.createDataFrame([(d, *r) for d, rows in days.items() for r in rows], "day string, m int, p double, u double, s boolean, go boolean").coalesce(1)
    want = sorted((d, *t) for d, rows in days.items() for t in plain_trades(rows, x))
    have = sorted(map(tuple, rule_trades(df, ["day"], "m", "p", F.col("s"), x, "u", F.col("go")).collect()))
    assert [(r[:3], r[6]) for r in have] == [(r[:3], r[6]) for r in want] and max(r[2] - r[1] for r in want) > 100
    for a, b in zip(have, want, strict=True):
        assert a[3:6] + a[7:] == pytest.approx(b[3:6] + b[7:])


def test_rule_trades_of_a_day_of_many_rows_take_time_in_proportion(spark):
    n, x = 240_000, Exits(0.5, 1.0, 12, 400, 0.6, 0.3)
    df = spark.range(n, numPartitions=2).selectExpr("'d' AS day", "id + 1 AS m", "id * 7919 % 10007 + 1.0 AS p", "id * 7919 % 10007 < (id + 10006) * 7919 % 10007 AS s")
    began = time.monotonic()
    got = rule_trades(df, ["day"], "m", "p", F.col("s"), x).collect()
    took = time.monotonic() - began
    rows = [(i + 1, i * 7919 % 10007 + 1.0, None, i * 7919 % 10007 < (i + 10006) * 7919 % 10007, False) for i in range(n)]
    assert sorted(r[1:4] for r in got) == sorted(r[:3] for r in plain_trades(rows, x)) and len(got) > n / 4
    assert took < 30


@pytest.mark.parametrize("without", [0.0, 0.1])
def test_sql_of_rule_trades_has_every_trade_of_a_plain_walk(spark, tmp_path, without):
    from tests.compare import tables
    from tickloom.plans import catalogue, training_queries

    rng = random.Random(12)
    ticks = [(i, T0 + dt.timedelta(days=i % 2, seconds=i * 20), rng.choice([None, 0.0, -1.0]) if rng.random() < without else round(rng.lognormvariate(1, 0.5), 2), rng.choice([None, *range(101)])) for i in range(2000)]
    rows = [(i, t, 1, "view", p, "{}" if k is None else f'{{"k": {k}}}') for i, t, p, k in ticks]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "made"))
    sf = tmp_path / "sf"
    sf.mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(sf / "events.parquet")
    want = []
    for day in sorted({t.date() for _, t, _, _ in ticks}):
        of = sorted((t, i, p, k) for i, t, p, k in ticks if t.date() == day)
        before = [None] + [p for _, _, p, _ in of]
        walk = [(n, p, None if k is None else k + 50.0, p is not None and b is not None and p < b, k is not None and k >= 95) for n, ((_, _, p, k), b) in enumerate(zip(of, before), 1)]
        want += [(day, t[0], t[1], t[5]) for t in plain_trades(walk, training_queries._RULE)]
    sql = tables(str(sf)).sql(f"SELECT session, entry_minute, exit_minute, exit_reason FROM ({catalogue.ORACLE['lbl_12_rule_trades']})").fetchall()
    got = catalogue.QUERIES["lbl_12_rule_trades"](spark, str(sf)).select("session", "entry_minute", "exit_minute", "exit_reason").collect()
    assert sorted(sql) == sorted(want) == sorted(map(tuple, got)) and len(want) > 500
