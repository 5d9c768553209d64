"""Order-dependent scans (SCN family): recurrences over a session's sorted array, in SQL higher-order functions.

A session is a bounded group (a day of minutes).  For series without such a bound ewm_long, rsi_long, atr_long, macd_long, adx_long and cusum_long carry
a state per block (a day) from block to block instead of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import stored
from .counting import positions
from .windows import over, rolling, running


def _sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per session: rows, the array of its rows as structs in order."""
    ordered = F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*(F.col(c) for c in df.columns)).alias("_row"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(ordered)).alias("_rows")).select(F.transform("_rows", lambda r: r["_row"]).alias("_rows"))


#: Rows of a chunk: outputs are collected in arrays of this length, so a session of n rows costs n * CHUNK / 2
#: copies of one value (and n / CHUNK squared of a reference), not n squared.
CHUNK = 48


def fold_chunks(rows: Column, state: Column, kind: str, step, emit) -> Column:
    """The array of emit(state, row) after each state = step(state, row), chunk by chunk."""
    empty = F.array().cast(f"array<{kind}>")

    def one(a: Column, r: Column) -> Column:
        s = step(a["s"], r)
        return F.struct(s.alias("s"), F.concat(a["o"], F.array(emit(s, r))).alias("o"))

    def chunk(a: Column, part: Column) -> Column:
        now = F.aggregate(part, F.struct(a["x"]["s"].alias("s"), empty.alias("o")), one)
        return F.struct(now.alias("x"), F.concat(a["done"], F.array(a["x"]["o"])).alias("done"))

    n = F.ceil(F.size(rows) / CHUNK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(rows, i * CHUNK + 1, F.lit(CHUNK)))
    start = F.struct(F.struct(state.alias("s"), empty.alias("o")).alias("x"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    return F.aggregate(parts, start, chunk, lambda a: F.flatten(F.concat(a["done"], F.array(a["x"]["o"]))))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, step, emit, out: str) -> DataFrame:
    """Fold the session in order: state = step(state, row), and column `out` = emit(state, row) after each step."""
    g = _sorted(df, keys, order)
    kind = g.select(F.transform("_rows", lambda r: emit(start, r)).alias("x")).schema["x"].dataType.elementType.simpleString()
    done = g.withColumn("_o", fold_chunks(F.col("_rows"), start, kind, step, emit))
    pairs = done.select(F.explode(F.arrays_zip("_rows", "_o")).alias("p"))
    return pairs.select("p._rows.*", F.col("p._o").alias(out))


def ewm(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str], out: str, span: float | None = None, alpha: float | None = None, least: int = 1) -> DataFrame:
    """SCN-1: exponentially weighted mean, adjust=False.  A null repeats the last value and decays its weight:
    after k nulls y = ((1-a)^(k+1) y + a x) / ((1-a)^(k+1) + a).  Fewer than `least` values so far give null."""
    a = alpha if alpha is not None else 2.0 / (span + 1)
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(0).alias("n"))

    return scan(df, keys, order, start, lambda s, r: _smoothed(s, r[x].cast("double"), a), lambda s, r: F.when(s["n"] >= least, s["y"]), out)


def ewm_long(df: DataFrame, x: str, keys: Sequence[str], block: str, order: Sequence[str], out: str, alpha: float, least: int = 1) -> DataFrame:
    """SCN-1 for a series of any length: as ewm over all blocks (days) of a key.

    A block is the affine map y -> p y + q of the last value before it, given the nulls since that value, which
    decay its weight and are known from counts.  The maps of all blocks before are composed by doubling, in
    log2(blocks) windows over a row per block, then each block is folded from its own start.
    """
    per = _sorted(df, [*keys, block], order)
    per = per.select(*(F.col("_rows")[0][k].alias(k) for k in (*keys, block)), F.transform("_rows", lambda r: r[x].cast("double")).alias("_v"), "_rows")
    some = F.filter("_v", lambda v: v.isNotNull())
    tail = F.aggregate("_v", F.lit(0), lambda a, v: F.when(v.isNull(), a + 1).otherwise(0))
    rows = per.select(*keys, block, F.size("_v").alias("_n"), F.size(some).alias("_c"), tail.alias("_t"), F.get(some, F.lit(0)).alias("_f"))
    w = over(keys, [block])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_to", F.sum("_n").over(running(w)))
    value_at = F.max(F.when(F.col("_c") > 0, F.col("_to") - F.col("_t"))).over(before)  # the row of the last value before the block
    rows = rows.withColumns({"_gap": F.col("_to") - F.col("_n") - value_at, "_seen": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_first": F.first("_f", ignorenulls=True).over(before)})
    weight = F.when(F.col("_gap").isNull(), 1.0).otherwise(F.pow(F.lit(1 - alpha), F.col("_gap")))
    rows = rows.select(*keys, block, weight.alias("_w"), "_seen", "_first", F.col("_f"))
    per = stored(per.join(rows, [*keys, block]), "ewm")
    ident = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("q"), F.col("_w").alias("w"))

    def compose(a: Column, v: Column) -> Column:
        wt = a["w"] * (1 - alpha)
        p, q = a["p"] * wt / (wt + alpha), (a["q"] * wt + alpha * v) / (wt + alpha)
        return F.struct(F.when(v.isNull(), a["p"]).otherwise(p).alias("p"), F.when(v.isNull(), a["q"]).otherwise(q).alias("q"), F.when(v.isNull(), wt).otherwise(F.lit(1.0)).alias("w"))

    maps = stored(per.select(*keys, block, F.aggregate("_v", ident, compose).alias("m")), "ewm-maps")
    chain = maps.select(*keys, block, F.lag("m.p").over(w).alias("_p"), F.lag("m.q").over(w).alias("_q"))
    most = maps.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 1
    back = 1
    while back < most:
        p, q = F.lag("_p", back).over(w), F.lag("_q", back).over(w)
        chain = chain.withColumns({"_p": F.coalesce(p * F.col("_p"), "_p"), "_q": F.coalesce(q * F.col("_p") + F.col("_q"), "_q")})
        back *= 2
    both = per.join(chain, [*keys, block])
    # a map leaves the first value of all where it is, so the series may begin with it
    start = F.struct((F.col("_p") * F.col("_first") + F.col("_q")).alias("y"), F.col("_w").alias("w"), F.col("_seen").alias("n"))
    done = both.withColumn("_o", fold_chunks(F.col("_v"), start, "double", lambda s, v: _smoothed(s, v, alpha), lambda s, v: F.when(s["n"] >= least, s["y"])))
    return done.select(F.explode(F.arrays_zip("_rows", "_o")).alias("p")).select("p._rows.*", F.col("p._o").alias(out))


def _smoothed(s: Column, v: Column, alpha: float) -> Column:
    w = s["w"] * (1 - alpha)
    y = F.when(v.isNull(), s["y"]).when(s["y"].isNull(), v).otherwise((w * s["y"] + alpha * v) / (w + alpha))
    return F.struct(y.alias("y"), F.when(v.isNull() & s["y"].isNotNull(), w).otherwise(F.lit(1.0)).alias("w"), (s["n"] + v.isNotNull().cast("int")).alias("n"))


def lag_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str], block: str, order: Sequence[str], out: str) -> DataFrame:
    """df with `out`, a struct of the columns in the row before, over all blocks of a key: the first row of a block meets the last of the
    block before, a row per block; null on the first row of all."""
    row = F.struct(*(F.col(c).alias(c) for c in columns))
    last = df.groupBy(*keys, block).agg(F.max_by(row, F.struct(*order)).alias("_l"))
    ends = last.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, block])), F.lag("_l").over(over(keys, [block])).alias("_before"))
    both = df.withColumn("_in", F.lag(row).over(over([*keys, block], order))).join(ends, [df[c].eqNullSafe(ends[f"_k{i}"]) for i, c in enumerate([*keys, block])])
    return both.withColumn(out, F.coalesce("_in", "_before")).select(*df.columns, out)


def differences_long(df: DataFrame, x: str, keys: Sequence[str], block: str, order: Sequence[str], out: str) -> DataFrame:
    """x less the row before it, over all blocks of a key."""
    return lag_long(df, [x], keys, block, order, "_prev").withColumn(out, F.col(x) - F.col("_prev")[x]).drop("_prev")


def rsi_long(df: DataFrame, x: str, keys: Sequence[str], block: str, order: Sequence[str], out: str = "rsi", n: int = 14, zero_loss: str = "null") -> DataFrame:
    """SCN-2 for a series of any length: as rsi over all blocks of a key."""
    df = differences_long(df, x, keys, block, order, "_d")
    df = df.withColumn("_up", F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0)))).withColumn("_down", F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))).drop("_d")
    df = ewm_long(df, "_up", keys, block, order, "_g", 1 / n, n)
    df = ewm_long(df, "_down", keys, block, order, "_l", 1 / n, n)
    return df.withColumn(out, _strength(zero_loss)).drop("_up", "_down", "_g", "_l")


def _strength(zero_loss: str) -> Column:
    quiet = {"null": F.lit(None).cast("double"), "100": F.lit(100.0), "mid": F.when(F.col("_g") == 0, 50.0).otherwise(100.0)}[zero_loss]
    return F.when(F.col("_l").isNull(), None).when(F.col("_l") == 0, quiet).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))


def rsi(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str], out: str = "rsi", n: int = 14, zero_loss: str = "null") -> DataFrame:
    """SCN-2: Wilder's RSI.  With no losses: null, 100, or 100 and 50 if there are no gains either ('mid')."""
    d = F.col(x) - F.lag(x).over(over(keys, order))
    df = df.withColumn("_d", d)
    df = df.withColumn("_up", F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0)))).withColumn("_down", F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))).drop("_d")
    df = ewm(df, "_up", keys, order, "_g", alpha=1 / n, least=n)
    df = ewm(df, "_down", keys, order, "_l", alpha=1 / n, least=n)
    return df.withColumn(out, _strength(zero_loss)).drop("_up", "_down", "_g", "_l")


def true_range(high: str, low: str, close: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    pc = F.lag(close).over(over(keys, order))
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - pc), F.abs(F.col(low) - pc))


def atr(df: DataFrame, high: str, low: str, close: str, keys: Sequence[str], order: Sequence[str], out: str = "atr", n: int = 14, seeded: bool = False) -> DataFrame:
    """SCN-3: true range (the first: high - low), smoothed with 1/n.  seeded: ranges count from the second row on, the mean of the first n
    is the first value, and there is none before."""
    df = df.withColumn("_tr", true_range(high, low, close, keys, order))
    if not seeded:
        return ewm(df, "_tr", keys, order, out, alpha=1 / n).drop("_tr")
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("y"))

    def step(s: Column, r: Column) -> Column:
        i, tr = s["i"] + 1, F.when(s["i"] >= 0, r["_tr"]).otherwise(0.0)
        total = F.when(i <= n, s["s"] + tr).otherwise(s["s"])
        return F.struct(i.alias("i"), total.alias("s"), F.when(i == n, total / n).when(i > n, s["y"] + (tr - s["y"]) / n).alias("y"))

    return scan(df, keys, order, start, step, lambda s, r: s["y"], out).drop("_tr")


def macd(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str], fast: int = 12, slow: int = 26, signal: int = 9, least: int = 35) -> DataFrame:
    """SCN-4: macd, macd_signal, macd_hist; null before `least` rows."""
    df = ewm(df, x, keys, order, "_f", span=fast)
    df = ewm(df, x, keys, order, "_s", span=slow)
    df = ewm(df.withColumn("_m", F.col("_f") - F.col("_s")), "_m", keys, order, "_sig", span=signal)
    enough = F.row_number().over(over(keys, order)) >= least
    df = df.withColumn("_ok", enough)
    return df.withColumns({"macd": F.when(F.col("_ok"), F.col("_m")), "macd_signal": F.when(F.col("_ok"), F.col("_sig")), "macd_hist": F.when(F.col("_ok"), F.col("_m") - F.col("_sig"))}).drop("_f", "_s", "_m", "_sig", "_ok")


def adx(df: DataFrame, high: str, low: str, close: str, keys: Sequence[str], order: Sequence[str], n: int = 14) -> DataFrame:
    """SCN-5: plus_di, minus_di, adx with Wilder smoothing."""
    w = over(keys, order)
    up, down = F.col(high) - F.lag(high).over(w), F.lag(low).over(w) - F.col(low)
    df = df.withColumn("_tr", true_range(high, low, close, keys, order)).withColumn("_p", F.when((up > down) & (up > 0), up).otherwise(0.0)).withColumn("_n", F.when((down > up) & (down > 0), down).otherwise(0.0))
    for c in ("_tr", "_p", "_n"):
        df = ewm(df, c, keys, order, f"{c}s", alpha=1 / n)
    df = df.withColumn("plus_di", F.try_divide(100 * F.col("_ps"), "_trs")).withColumn("minus_di", F.try_divide(100 * F.col("_ns"), "_trs"))
    df = df.withColumn("_dx", F.try_divide(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return ewm(df, "_dx", keys, order, "adx", alpha=1 / n).drop("_tr", "_p", "_n", "_trs", "_ps", "_ns", "_dx")


def _range_long(p: str, high: str, low: str, close: str) -> Column:
    pc = F.col(p)[close]
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - pc), F.abs(F.col(low) - pc))


def atr_long(df: DataFrame, high: str, low: str, close: str, keys: Sequence[str], block: str, order: Sequence[str], out: str = "atr", n: int = 14) -> DataFrame:
    """SCN-3 for a series of any length: as atr over all blocks of a key."""
    df = lag_long(df, [close], keys, block, order, "_prev").withColumn("_tr", _range_long("_prev", high, low, close)).drop("_prev")
    return ewm_long(df, "_tr", keys, block, order, out, 1 / n).drop("_tr")


def macd_long(df: DataFrame, x: str, keys: Sequence[str], block: str, order: Sequence[str], fast: int = 12, slow: int = 26, signal: int = 9, least: int = 35) -> DataFrame:
    """SCN-4 for a series of any length: as macd over all blocks of a key."""
    df = ewm_long(df, x, keys, block, order, "_f", 2.0 / (fast + 1))
    df = ewm_long(df, x, keys, block, order, "_s", 2.0 / (slow + 1))
    df = ewm_long(df.withColumn("_m", F.col("_f") - F.col("_s")), "_m", keys, block, order, "_sig", 2.0 / (signal + 1))
    df = positions(df, keys, block, order, "_at")
    enough = F.col("_at") >= least - 1
    return df.withColumns({"macd": F.when(enough, F.col("_m")), "macd_signal": F.when(enough, F.col("_sig")), "macd_hist": F.when(enough, F.col("_m") - F.col("_sig"))}).drop("_f", "_s", "_m", "_sig", "_at")


def adx_long(df: DataFrame, high: str, low: str, close: str, keys: Sequence[str], block: str, order: Sequence[str], n: int = 14) -> DataFrame:
    """SCN-5 for a series of any length: as adx over all blocks of a key."""
    df = lag_long(df, [high, low, close], keys, block, order, "_prev")
    up, down = F.col(high) - F.col("_prev")[high], F.col("_prev")[low] - F.col(low)
    df = df.withColumns({"_tr": _range_long("_prev", high, low, close), "_p": F.when((up > down) & (up > 0), up).otherwise(0.0), "_n": F.when((down > up) & (down > 0), down).otherwise(0.0)}).drop("_prev")
    for c in ("_tr", "_p", "_n"):
        df = ewm_long(df, c, keys, block, order, f"{c}s", 1 / n)
    df = df.withColumn("plus_di", F.try_divide(100 * F.col("_ps"), "_trs")).withColumn("minus_di", F.try_divide(100 * F.col("_ns"), "_trs"))
    df = df.withColumn("_dx", F.try_divide(100 * F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return ewm_long(df, "_dx", keys, block, order, "adx", 1 / n).drop("_tr", "_p", "_n", "_trs", "_ps", "_ns", "_dx")


def bollinger(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str], n: int = 20, width: float = 2.0) -> DataFrame:
    """SCN-6: upper, lower, width relative to the mean, place between them; population spread."""
    w = over(keys, order)
    mean, sd = rolling(F.avg, x, n, n, w), rolling(F.stddev_pop, x, n, n, w)
    df = df.withColumn("bb_mean", mean).withColumn("_sd", sd)
    df = df.withColumn("bb_upper", F.col("bb_mean") + width * F.col("_sd")).withColumn("bb_lower", F.col("bb_mean") - width * F.col("_sd"))
    return df.withColumn("bb_width", F.try_divide(F.col("bb_upper") - F.col("bb_lower"), "bb_mean")).withColumn("bb_pct", F.try_divide(F.col(x) - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))).drop("_sd")


def _cusum_start(collapse: int) -> Column:
    """Sums, what the row shows, and rows since the last shown event of each side (no more than matter)."""
    far = F.lit(collapse + 1)
    return F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.lit(0).alias("e"), far.alias("gp"), far.alias("gn"))


def _cusum_step(collapse: int):
    def step(s: Column, d: Column, t: Column) -> Column:
        d = F.coalesce(d, F.lit(0.0))
        p, n = F.greatest(F.lit(0.0), s["p"] + d), F.least(F.lit(0.0), s["n"] + d)
        gp, gn = F.least(s["gp"] + 1, F.lit(collapse + 1)), F.least(s["gn"] + 1, F.lit(collapse + 1))
        up, down = F.coalesce(p > t, F.lit(False)), F.coalesce(n < -t, F.lit(False))
        shown = F.when(up, F.when(gp > collapse, 1).otherwise(0)).when(down, F.when(gn > collapse, -1).otherwise(0)).otherwise(0)
        zero = up | down
        return F.struct(F.when(zero, 0.0).otherwise(p).alias("p"), F.when(zero, 0.0).otherwise(n).alias("n"), shown.alias("e"), F.when(shown == 1, 0).otherwise(gp).alias("gp"), F.when(shown == -1, 0).otherwise(gn).alias("gn"))

    return step


def cusum(df: DataFrame, x: str, threshold: str, keys: Sequence[str], order: Sequence[str], collapse: int = 0, out: str = "event") -> DataFrame:
    """SCN-7: 1 or -1 where the running sum of changes passes the row's threshold, which resets both sums; the same side
    doesn't fire again within `collapse` rows."""
    df = df.withColumn("_d", F.col(x) - F.lag(x).over(over(keys, order)))
    step = _cusum_step(collapse)
    return scan(df, keys, order, _cusum_start(collapse), lambda s, r: step(s, r["_d"], r[threshold]), lambda s, r: s["e"], out).drop("_d")


def cusum_long(df: DataFrame, x: str, threshold: str, keys: Sequence[str], block: str, order: Sequence[str], collapse: int = 0, out: str = "event") -> DataFrame:
    """SCN-7 over the whole frame: as cusum over all blocks (days) of a key, exactly.

    Every block is folded from a fresh start, then again from the end of the block before, as long as that
    changes its start.  Resets make runs from different starts meet, so after a few rounds, each of the
    blocks still open only, all starts are true; in the worst case there are as many rounds as blocks.  A row per
    block goes from round to round.
    """
    step, fresh = _cusum_step(collapse), _cusum_start(collapse)
    given = differences_long(df, x, keys, block, order, "_d")
    per = _sorted(given, [*keys, block], order)
    per = stored(per.select(*(F.col("_rows")[0][k].alias(k) for k in (*keys, block)), "_rows"), "cusum")
    w = over(keys, [block])
    fold = lambda start: F.aggregate("_rows", start, lambda s, r: step(s, r["_d"], r[threshold]))
    kind = per.select(fold(fresh).alias("s")).schema["s"].dataType.simpleString()
    state = per.select(*keys, block, fresh.cast(kind).alias("start"), F.lit(None).cast(kind).alias("end"), F.lit(True).alias("open"))
    while True:
        now = state.where("open").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, block])), F.col("start").alias("_from"))
        again = per.join(now, [per[c].eqNullSafe(now[f"_k{i}"]) for i, c in enumerate([*keys, block])]).select(*(f"_k{i}" for i in range(len(keys) + 1)), fold(F.col("_from")).cast(kind).alias("_to"))
        both = state.join(again, [state[c].eqNullSafe(again[f"_k{i}"]) for i, c in enumerate([*keys, block])], "left").select(*keys, block, "start", F.coalesce("_to", "end").alias("end"))
        true = F.coalesce(F.lag("end").over(w), fresh.cast(kind))
        state = stored(both.withColumn("_true", true).select(*keys, block, F.col("_true").alias("start"), "end", (~F.col("_true").eqNullSafe(F.col("start"))).alias("open")), "cusum-starts")
        if not state.where("open").limit(1).count():
            break
    starts = state.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, block])), "start")
    both = per.join(starts, [per[c].eqNullSafe(starts[f"_k{i}"]) for i, c in enumerate([*keys, block])])
    done = both.withColumn("_o", fold_chunks(F.col("_rows"), F.col("start"), "int", lambda s, r: step(s, r["_d"], r[threshold]), lambda s, r: s["e"]))
    return done.select(F.explode(F.arrays_zip("_rows", "_o")).alias("p")).select(*(F.col(f"p._rows.{c}") for c in df.columns), F.col("p._o").alias(out))


def equity(df: DataFrame, ret: str, keys: Sequence[str], order: Sequence[str], form: str = "additive", capital: float = 1.0) -> DataFrame:
    """SCN-8, SCN-9: columns equity, peak and drawdown after each trade.

    additive: capital + running sum; geometric: capital * product of (1 + r), zero for good after r <= -1;
    capital: additive, with the drawdown as a share of the peak and no less than -1.
    """
    w = running(over(keys, order))
    r = F.coalesce(F.col(ret), F.lit(0.0))
    if form == "geometric":
        ruined = F.max((r <= -1).cast("int")).over(w) == 1
        value = F.when(ruined, 0.0).otherwise(capital * F.exp(F.sum(F.when(r > -1, F.log1p(r))).over(w)))
    else:
        value = capital + F.sum(r).over(w)
    df = df.withColumn("equity", value)
    df = df.withColumn("peak", F.greatest(F.lit(float(capital)), F.max("equity").over(w)))
    fall = F.col("equity") - F.col("peak")
    if form != "additive":
        fall = F.greatest(F.lit(-1.0), F.try_divide(fall, "peak"))
    return df.withColumn("drawdown", fall)


def max_drawdown(df: DataFrame, ret: str, keys: Sequence[str], order: Sequence[str], form: str = "additive", capital: float = 1.0) -> DataFrame:
    """SCN-8: the deepest drawdown as a positive number, per keys."""
    return equity(df, ret, keys, order, form, capital).groupBy(*keys).agg((-F.min("drawdown")).alias("max_drawdown"))


def daily_equity(df: DataFrame, ret: str, day: str, keys: Sequence[str], order: Sequence[str], capital: float = 1.0) -> DataFrame:
    """SCN-9: per day: trades, start and end equity, day return, best and worst trade, drawdown at the close."""
    curve = equity(df, ret, keys, order, "additive", capital)
    last = F.max_by(F.struct("equity", "drawdown"), F.struct(*order))
    per = curve.groupBy(*keys, day).agg(F.count("*").alias("trades"), F.sum(ret).alias("day_sum"), F.max(ret).alias("best"), F.min(ret).alias("worst"), last.alias("z"))
    return per.select(*keys, day, "trades", (F.col("z.equity") - F.col("day_sum")).alias("start_equity"), F.col("z.equity").alias("end_equity"), F.try_divide("day_sum", F.col("z.equity") - F.col("day_sum")).alias("day_return"), "best", "worst", F.col("z.drawdown").alias("drawdown"))


def streaks(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SCN-10: longest runs of wins and of losses; a zero ends both."""
    w = over(keys, order)
    df = df.withColumn("_s", F.signum(x)).withColumn("_g", F.row_number().over(w) - F.row_number().over(over([*keys, "_s"], order)))
    runs = df.groupBy(*keys, "_s", "_g").agg(F.count("*").alias("n"))
    longest = lambda v: F.coalesce(F.max(F.when(F.col("_s") == v, F.col("n"))), F.lit(0)).cast("long")
    return runs.groupBy(*keys).agg(longest(1.0).alias("win_streak"), longest(-1.0).alias("loss_streak"))


def non_overlapping(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, signal: str) -> DataFrame:
    """SCN-11: greedy: in order, accept a row with a signal whose start is at or after the end of the last accepted one."""
    init = F.struct(F.lit(None).cast("double").alias("until"), F.lit(False).alias("take"))

    def step(s: Column, r: Column) -> Column:
        free = s["until"].isNull() | (r[start].cast("double") >= s["until"])
        take = F.coalesce(r[signal].cast("boolean") & free, F.lit(False))
        return F.struct(F.when(take, r[end].cast("double")).otherwise(s["until"]).alias("until"), take.alias("take"))

    return scan(df, keys, order, init, step, lambda s, r: s["take"], "accepted")


def sequence_match(df: DataFrame, first: Column, then: Column, keys: Sequence[str], order: Sequence[str], within: int, out: str = "matched") -> DataFrame:
    """SCN-12: true where `then` holds and `first` held within the last `within` rows before and wasn't used yet."""
    df = df.withColumn("_a", F.coalesce(first, F.lit(False))).withColumn("_b", F.coalesce(then, F.lit(False)))
    init = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("at"), F.lit(False).alias("hit"))

    def step(s: Column, r: Column) -> Column:
        i = s["i"] + 1
        armed = (s["at"] > 0) & (i - s["at"] <= within)
        hit = r["_b"] & armed
        at = F.when(hit, F.when(r["_a"], i).otherwise(-1)).when(r["_a"] & ~armed, i).otherwise(F.when(armed, s["at"]).otherwise(-1))
        return F.struct(i.alias("i"), at.alias("at"), hit.alias("hit"))

    return scan(df, keys, order, init, step, lambda s, r: s["hit"], out).drop("_a", "_b")
