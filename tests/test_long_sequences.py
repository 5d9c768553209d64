"""Ranks, scans and overlaps of long or dense sequences against plain Python."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import counting as N
from tickloom.operators import joins as J
from tickloom.operators import scans as C
from tickloom.operators import windows as W


def test_merge_counting():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        v = rng.integers(0, 25, n).astype(float)
        less, same = N.earlier(v)
        assert all(less[i] == (v[:i] < v[i]).sum() and same[i] == (v[:i] == v[i]).sum() for i in range(n))
        for w in (1, 5, 100, 1000):
            upto, seen = N.trailing(v, w)
            assert all(upto[i] == (v[max(0, i - w) : i] <= v[i]).sum() and seen[i] == min(i, w) for i in range(n))


def test_one_session_of_100000_rows_is_ranked_in_seconds(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5000, 100_000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": np.arange(len(x)), "x": x}))
    began = time.time()
    got = W.expanding_rank(df, "x", ["k"], ["i"], "r").select("i", "r").toPandas().sort_values("i")["r"].to_numpy()
    assert time.time() - began < 60
    at = [10, 5_000, 99_999]
    assert [got[i] for i in at] == pytest.approx([((x[: i + 1] < x[i]).sum() + ((x[: i + 1] == x[i]).sum() + 1) / 2) / (i + 1) for i in at]) and np.isnan(got[:4]).all()


@pytest.mark.parametrize("rows", [3, 10, 1000])
def test_history_of_rows_goes_over_days_and_skips_nulls(spark, rows):
    rng = random.Random(3)
    data = [("ab"[i % 2] if i % 11 else None, i // 20, i, None if rng.random() < 0.2 else float(rng.randrange(12))) for i in range(240)]
    df = spark.createDataFrame(data, "k string, d int, i int, x double")
    got = {r.i: r.out for r in N.history_percentile_rows(df, "x", ["k"], "d", ["i"], "out", rows, least=2).collect()}
    past = {}
    for k, _, i, x in data:
        before = past.setdefault(k, [])[-rows:]
        assert got[i] == (pytest.approx(100 * sum(b <= x for b in before) / len(before)) if x is not None and len(before) >= 2 else None)
        if x is not None:
            past[k].append(x)


@pytest.mark.parametrize("block", [3, 50, 1000])
def test_scans_over_the_whole_frame(spark, block):
    rng = random.Random(4)
    x, rows = 100.0, []
    for i in range(230):
        x += rng.gauss(0, 3)
        rows.append(("a", i // block, i, None if i < 3 or rng.random() < 0.15 or 60 < i < 75 else x, 6.0 if i % 3 else 9.0))
    df = spark.createDataFrame(rows, "k string, b int, i int, x double, t double").repartition(3)
    series = pd.Series([r[3] for r in rows], dtype=float)
    got = [r.y for r in C.ewm_long(df, "x", ["k"], "b", ["i"], "y", 0.2, 3).orderBy("i").collect()]
    want = series.ewm(alpha=0.2, adjust=False, min_periods=3).mean()
    assert [g if g is not None else float("nan") for g in got] == pytest.approx(want.tolist(), nan_ok=True)
    if block == 50:
        a, b = ({r.i: r.rsi for r in d.collect()} for d in (C.rsi_long(df, "x", ["k"], "b", ["i"]), C.rsi(df, "x", ["k"], ["i"])))
        assert all((a[i] is None and b[i] is None) or a[i] == pytest.approx(b[i]) for i in a) and sum(v is not None for v in a.values()) > 100
    for collapse in (0, 7):
        got = {r.i: r.event for r in C.cusum_long(df, "x", "t", ["k"], "b", ["i"], collapse).collect()}
        want = {r.i: r.event for r in C.cusum(df, "x", "t", ["k"], ["i"], collapse).collect()}
        assert got == want and {1, -1, 0} == set(want.values())


@pytest.mark.parametrize("rows", [5, 64, 4096])
def test_overlaps_of_a_dense_hour(spark, rows):
    rng = random.Random(5)
    base = 1_700_000_000
    data = [(k, i, base + rng.randrange(3000), rng.choice([0, 1, 1, 5, 4000]) if i % 40 else 100_000) for k in ("a", "b", None) for i in range(160)]
    df = spark.createDataFrame([(k, i, s, s + n) for k, i, s, n in data], "k string, id int, s long, e long").selectExpr("k", "id", "timestamp_seconds(s) s", "timestamp_seconds(e) e")
    got = sorted(tuple(r) for r in J.self_overlaps(df, ["k"], "id", "s", "e", rows).collect())
    want = sorted((k, i, j) for k, i, s, n in data for k2, j, s2, n2 in data if k and k == k2 and n > 0 and n2 > 0 and (s, i) < (s2, j) and s + n > s2)
    assert got == want
    assert J.self_overlaps(df.limit(0), ["k"], "id", "s", "e").count() == 0


def test_indicators_over_days_equal_those_of_one_session(spark):
    rng = random.Random(6)
    x, rows = 100.0, []
    for i in range(160):
        x += rng.gauss(0, 2)
        rows.append(("a", i // 30, i, x + rng.random(), x - rng.random(), x))
    df = spark.createDataFrame(rows, "k string, b int, i int, h double, l double, c double").repartition(3)
    pairs = [
        (C.atr_long(df, "h", "l", "c", ["k"], "b", ["i"]), C.atr(df, "h", "l", "c", ["k"], ["i"]), ["atr"]),
        (C.macd_long(df, "c", ["k"], "b", ["i"]), C.macd(df, "c", ["k"], ["i"]), ["macd", "macd_signal", "macd_hist"]),
        (C.adx_long(df, "h", "l", "c", ["k"], "b", ["i"]), C.adx(df, "h", "l", "c", ["k"], ["i"]), ["plus_di", "minus_di", "adx"]),
    ]
    for long, short, columns in pairs:
        a, b = (d.select("i", *columns).toPandas().sort_values("i")[columns].to_numpy(float) for d in (long, short))
        np.testing.assert_allclose(a, b, rtol=1e-9)
        assert np.isfinite(a[-1]).all()
