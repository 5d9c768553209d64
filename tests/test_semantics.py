"""Hand-computed cases of rules that are easy to get wrong."""

import math
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalar as S
from tickloom.operators import chain as CH
from tickloom.operators import evaluate as E
from tickloom.operators import joins as J
from tickloom.operators import labels as L
from tickloom.operators import quality as Q
from tickloom.operators import scans as C
from tickloom.operators import select as T
from tickloom.operators import windows as W
from tickloom.sources import readers, writers


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_ewm_repeats_and_decays_over_nulls(spark):
    x = [1.0, None, None, 2.0, 5.0, None, 3.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, i int, x double")
    got = [r.y for r in C.ewm(df, "x", ["k"], ["i"], "y", span=3).orderBy("i").collect()]
    want = pd.Series(x).ewm(span=3, adjust=False).mean().tolist()
    assert got == pytest.approx(want)


def test_long_ewm_equals_short_one(spark):
    rows = [("a", i // 5, i, float((i * 37) % 11)) for i in range(23)]
    df = spark.createDataFrame(rows, "k string, d int, i int, x double")
    got = [r.y for r in C.ewm_long(df, "x", ["k"], "d", ["i"], "y", 0.3).orderBy("i").collect()]
    assert got == pytest.approx(pd.Series([r[3] for r in rows]).ewm(alpha=0.3, adjust=False).mean().tolist())


def test_rsi_rules_without_losses(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "k string, i int, x double")
    for rule, want in (("null", None), ("100", 100.0), ("mid", 100.0)):
        assert C.rsi(df, "x", ["k"], ["i"], zero_loss=rule).orderBy(F.desc("i")).first().rsi == want


def test_predicates_are_false_on_null(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,)], "x double")
    for op, n in (("!=", 1), ("==", 1), (">", 1)):
        assert df.where(S.condition({"column": "x", "operator": op, "value": 1.0})).count() == n
    assert df.where(S.all_of([])).count() == 3 and df.where(S.any_of([])).count() == 0


def test_contract_symbols(spark):
    got = one(spark, S.contract_fields(F.lit("alpha25JAN2448100CE")))
    assert (got.underlying, str(got.expiry), got.strike, got.side) == ("ALPHA", "2024-01-25", 48100.0, "CE")
    got = one(spark, S.contract_fields(F.lit("BETA4JUL202422000PE")))
    assert (str(got.expiry), got.strike) == ("2024-07-04", 22000.0)
    assert one(spark, S.contract_fields(F.lit("BETA24JANFUT"))) is None


def test_option_value_and_implied_volatility(spark):
    a = [F.lit(x) for x in (100.0, 100.0, 1.0, 0.05)]
    value = one(spark, S.option_value(*a, F.lit(0.2), F.lit(True)))
    assert value == pytest.approx(10.450583572185565, abs=1e-5)
    assert one(spark, S.implied_vol(F.lit(value), *a, F.lit(True))) == pytest.approx(0.2, abs=1e-5)
    assert one(spark, S.implied_vol(F.lit(200.0), *a, F.lit(True))) is None


def test_asof_takes_the_last_of_ties_and_keeps_left_rows(spark):
    left = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 3, 5)], "k string, id int, ts long")
    right = spark.createDataFrame([("a", 10, 1, 0.1), ("a", 10, 2, 0.2), ("a", 40, 3, 0.3)], "k string, ts long, r int, v double")
    got = {r.id: r.v for r in J.asof(left, right, ["k"], "ts", ["r", "v"], ["r"]).collect()}
    assert got == {1: 0.2, 2: 0.2, 3: None}
    got = {r.id: r.v for r in J.asof(left, right, ["k"], "ts", ["r", "v"], ["r"], "forward").collect()}
    assert got == {1: 0.1, 2: 0.3, 3: None}


def test_one_to_one_fails_on_repeated_keys(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="keys repeat"):
        J.one_to_one(a, spark.createDataFrame([(1, 2)], "k int, v int"), ["k"]).collect()


def test_max_pain_prefers_the_lowest_of_ties(spark):
    w = spark.createDataFrame([("t", 100, 1.0, 0.0), ("t", 110, 0.0, 0.0), ("t", 120, 0.0, 1.0)], "ts string, strike int, ce_oi double, pe_oi double")
    assert CH.max_pain(w, ["ts"]).first().max_pain == 100


def test_triple_barrier_same_bar_and_missing_minutes(spark):
    rows = [("d", m, 100.0, h, lo, 100.0) for m, h, lo in ((0, 100.0, 100.0), (1, 103.0, 97.0), (2, 100.0, 100.0), (4, 100.0, 100.0))]
    df = spark.createDataFrame(rows, "d string, m int, open double, high double, low double, close double")
    got = {r.m: r for r in L.triple_barrier(df, ["d"], "m", 2, F.lit(0.02), F.lit(0.02)).collect()}
    assert got[0].long_reason == "tp_sl_same_bar" and got[0].long_return == pytest.approx(0.02) and got[0].long_offset == 1
    assert got[1].long_reason == "invalid" and got[1].long_return is None


def test_option_path_reasons(spark):
    e = spark.createDataFrame([(1, "d", 0, 100, 10), (2, "d", 0, None, 10), (3, "d", 5, 100, 10)], "id int, d string, minute int, atm_strike int, strike_step int")
    r = spark.createDataFrame([("r", "CE", 1, 2, 0.5, 0.5)], "recipe_id string, side string, steps int, hold int, stop_pct double, target_pct double")
    q = spark.createDataFrame([("d", 0, 110, "CE", 10.0), ("d", 1, 110, "CE", 4.0), ("d", 2, 110, "CE", 20.0), ("d", 5, 110, "CE", 10.0)], "d string, minute int, strike int, side string, close double")
    got = {x.id: x for x in L.option_path(e, q, r, ["d"]).collect()}
    assert (got[1].exit_reason, got[1].exit_offset, got[1].pnl_pct) == ("stop", 1, pytest.approx(-0.6))
    assert got[2].reason_skipped == "no_atm" and got[3].reason_skipped == "missing_path"


def test_forward_move_label(spark):
    df = spark.createDataFrame([("d", i, 50000.0 + 24 * i) for i in range(8)], "d string, i int, px double").withColumns({"h": F.col("px") + 5, "l": F.col("px") - 5})
    got = L.forward_move(df, ["d"], ["i"], "px", "h", "l", 5, points=100).orderBy("i").collect()
    assert got[0].move_label == 1 and got[7].move_label is None


def test_equal_count_bins_and_auc_ties(spark):
    df = spark.createDataFrame([(i, 0.5, i % 2) for i in range(7)], "i int, p double, y int")
    assert [r.n for r in E.calibration(df, "p", "y", ["i"], 3).orderBy("bin").collect()] == [2, 2, 3]
    assert E.auc_brier(df, "p", "y").first().auc == pytest.approx(0.5)


def test_drawdown_forms_and_profit_factor(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, -0.5), ("a", 3, -2.0)], "k string, i int, r double")
    add = C.max_drawdown(df, "r", ["k"], ["i"]).first().max_drawdown
    geo = C.max_drawdown(df, "r", ["k"], ["i"], "geometric").first().max_drawdown
    assert add == pytest.approx(2.5) and geo == pytest.approx(1.0)
    wins = spark.createDataFrame([(1.0,)], "r double")
    assert wins.agg(E.profit_factor("r").alias("x")).first().x is None
    assert wins.agg(E.profit_factor("r", math.inf).alias("x")).first().x == math.inf


def test_latest_block_stops_at_gaps_and_bad_days(spark):
    days = spark.createDataFrame([("2024-01-01", True), ("2024-01-02", False), ("2024-01-03", True), ("2024-01-04", True), ("2024-01-09", False)], "d string, good boolean").withColumn("d", F.to_date("d"))
    got = Q.latest_block(days, "d", "good", 3).first()
    assert (str(got.first_day), str(got.last_day), got.days) == ("2024-01-03", "2024-01-04", 2)


def test_walk_forward_needs_whole_folds(spark):
    days = spark.createDataFrame([(i,) for i in range(6)], "d int")
    assert T.walk_forward(days, "d", 5, 1, 1, 1).count() == 0
    assert T.walk_forward(days, "d", 3, 1, 1, 1, purge=1).count() == 5


def test_forward_fill_never_backward(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("b", 4, None)], "k string, i int, x double")
    got = [r.x for r in W.forward_fill(df, ["x"], ["k"], ["i"]).orderBy("i").collect()]
    assert got == [None, 1.0, 1.0, None]


def test_csv_json_and_suffix_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("Trade Date,Open\n2024-01-05,1\n")
    (tmp_path / "a" / "y.csv").write_text("Trade Date,Open\n05-Jan-2024,oops\n")
    df = S.normalize_columns(readers.csv_folder(spark, str(tmp_path / "a"), recursive=True))
    got = sorted(((str(r.d), r.o) for r in df.select(S.parse_date("trade_date").alias("d"), S.number("open").alias("o")).collect()), key=str)
    assert got == [("2024-01-05", 1.0), ("2024-01-05", None)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.jsonl(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "t.tsv").write_text("A B\tC\n1\t2\n")
    assert readers.table(spark, str(tmp_path / "t.tsv")).columns == ["a_b", "c"]


def test_day_replace_keeps_other_days(spark):
    root = writers.scratch(spark, "t")
    a = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "d string, v int")
    writers.write_days(a, root, "d")
    writers.write_days(spark.createDataFrame([("2024-01-02", 5)], "d string, v int"), root, "d")
    assert sorted(r.v for r in readers.parquet_dataset(spark, root).collect()) == [1, 5]


def test_chunked_scan_equals_a_grouped_pandas_reference(spark):
    """UDF-2: the per-session grouped map is kept here as the reference of the SQL fold."""
    import pandas as pd

    rows = [(f"k{i % 3}", i, None if i % 17 == 5 else float((i * 37) % 101)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, x double")

    def reference(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        return g.assign(y=g["x"].ewm(alpha=0.2, adjust=False).mean())[["k", "i", "y"]]

    want = {(r.k, r.i): r.y for r in df.groupBy("k").applyInPandas(reference, "k string, i long, y double").collect()}
    for r in C.ewm(df, "x", ["k"], ["i"], "y", alpha=0.2).collect():
        assert abs(r.y - want[r.k, r.i]) < 1e-9


def test_upserts_go_on_where_they_stopped(spark, tmp_path):
    from tickloom.streaming import jobs as ST

    source, place = f"file://{tmp_path}/in", f"file://{tmp_path}/table"
    schema = "k long, at long, v string"
    for n, rows in enumerate(([(i, 1, "a") for i in range(50)], [(i, 2, "b") for i in range(0, 60, 7)] + [(3, 0, "old")], [(7, 5, "c"), (99, 1, "new")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        out = ST.run_upserts(stream, "t", ["k"], ["at"], folder=place, buckets=4)
    got = {r.k: (r.at, r.v) for r in out.collect()}
    want = {i: (1, "a") for i in range(50)} | {i: (2, "b") for i in range(0, 60, 7)} | {7: (5, "c"), 99: (1, "new")}
    assert got == want


def test_equal_count_bins_meet_their_edges(spark):
    rows = [(i, ((i * 7919) % 1000) / 999 if i % 10 else 0.5, i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s double, y boolean").withColumn("y", F.col("y").cast("int"))
    placed = sorted(rows, key=lambda r: (r[1], r[0]))
    cuts = [int(i * len(rows) / 7) for i in range(8)]
    got = {r.bin: (r.n, r.mean_score) for r in E.calibration(df, "s", "y", ["id"], 7).collect()}
    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        assert got[b][0] == hi - lo and abs(got[b][1] - sum(r[1] for r in placed[lo:hi]) / (hi - lo)) < 1e-9


def test_walk_forward_scores_unseen_days_and_quality_is_by_pairs(spark):
    import datetime as dt
    import random

    from tickloom.operators import learn as ML

    rng = random.Random(2)
    first = dt.date(2024, 1, 1)
    rows = []
    for d in range(14):
        for _ in range(30):
            x = rng.gauss(0, 1)
            rows.append((first + dt.timedelta(days=d), x, rng.gauss(0, 1) if rng.random() > 0.1 else None, float(x + rng.gauss(0, 0.7) > 0)))
    df = spark.createDataFrame(rows, "day date, a double, b double, label double")
    scores = ML.walk_forward_scores(df, "day", ["a", "b"], "label", 6, 2, 2, 4)
    got = scores.collect()
    assert {(r.fold, r.day) for r in got} == {(0, first + dt.timedelta(days=8)), (0, first + dt.timedelta(days=9)), (1, first + dt.timedelta(days=12)), (1, first + dt.timedelta(days=13))}
    assert len(got) == 120 and all(0 <= r.p <= 1 for r in got)
    for q in ML.fold_quality(scores, "label").collect():
        mine = [(r.p, r.label) for r in got if r.fold == q.fold]
        pairs = [(a, b) for a, y in mine if y for b, z in mine if not z]
        assert abs(q.auc - sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)) < 1e-9 and q.auc > 0.75 and q.edge == "EDGE"
        assert abs(q.brier - sum((p - y) ** 2 for p, y in mine) / len(mine)) < 1e-9
    up = spark.createDataFrame([(0.5, 0.8)], "g double, d double").select(ML.gated("g", "d").alias("x")).first().x
    assert (round(up.up, 9), round(up.down, 9)) == (0.4, 0.1)
    with pytest.raises(ValueError):
        ML.scored(None, df, ["a", "missing"])


def test_moves_from_a_price_of_zero(spark):
    px = [0.0, 1.0, 2.0, 0.0, 0.0, 1.0, 2.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(px)], "d string, i int, px double")
    got = [r.clean_move for r in L.clean_start(df, ["d"], ["i"], "px", 2, 0.5, 2).orderBy("i").collect()]
    assert got == [1, 0, 0, 0, 1, None, None]
    assert [tuple(r) for r in L.clock_return(df, ["d"], "i", "px", 3, 2, 0.2).select("ret", "label").collect()] == [(math.inf, 1)]


def test_volatilities_of_many_rows_are_solved_in_seconds(spark):
    vol, call, a = 0.05 + F.col("id") % 100 / 100, F.col("id") % 2 == 0, (F.lit(100.0), 80.0 + F.col("id") % 40, F.lit(0.25), F.lit(0.06))
    df = spark.range(0, 20_000, 1, 1).select("id", vol.alias("vol"), S.option_value(*a, vol, call).alias("value"), S.implied_vol(S.option_value(*a, vol, call), *a, call).alias("iv"))
    start = time.time()
    rows = df.toPandas()
    assert time.time() - start < 10
    sure = rows[(rows["value"] > 0.05) & rows["iv"].notna()]
    assert len(sure) > 15_000 and (sure["iv"] - sure["vol"]).abs().max() < 1e-3
    none = lambda value, *x: one(spark, S.implied_vol(F.lit(value).cast("double"), *(F.lit(y) for y in x), F.lit(True)))
    assert none(None, 100.0, 100.0, 0.25, 0.06) is None and none(5.0, 100.0, 100.0, 0.0, 0.06) is None and none(5.0, 100.0, 0.0, 0.25, 0.06) is None
