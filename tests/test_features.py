"""Features, folds and backtests against plain loops, hand cases and truncation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import by, ewm
from tidemark.operators import backtest as bt
from tidemark.operators import features as ft
from tidemark.operators import strategies as st


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(42)
    n = 160
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * np.exp(rng.normal(0, 0.005, n))
    return pd.DataFrame({"series": "S", "day": range(n), "open": open_, "high": np.maximum(open_, close) * 1.01, "low": np.minimum(open_, close) * 0.99, "close": close, "volume": rng.integers(1, 99, n).astype(float)})


def rows(df, column):
    return [r[column] for r in df.orderBy("day").collect()]


def same(a, b, tol=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if y is None or (isinstance(y, float) and math.isnan(y)):
            assert x is None
        else:
            assert x == pytest.approx(y, rel=tol, abs=tol)


def test_ewm_matches_pandas(spark, walk):
    x = walk["close"].where(walk.index % 17 != 5)
    df = spark.createDataFrame(walk.assign(x=x.astype(object).where(x.notna(), None))[["series", "day"]].assign(x=[None if v != v else v for v in x]), "series string, day long, x double")
    got = rows(df.withColumn("m", ewm(F.col("x"), by("series", "day"), 1 / 14, 14)), "m")
    same(got, x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean().tolist(), 1e-8)


def test_rsi_atr_adx_have_warm_up(spark, walk):
    df = spark.createDataFrame(walk)
    delta = walk["close"].diff()
    up, down = delta.clip(lower=0), (-delta).clip(lower=0)
    mean = lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    same(rows(ft.rsi(df), "rsi"), (100 - 100 / (1 + mean(up) / mean(down))).tolist(), 1e-7)
    assert rows(ft.adx(df), "adx")[:26] == [None] * 26 or rows(ft.adx(df), "adx")[0] is None


def test_rsi_is_100_without_losses(spark):
    df = spark.createDataFrame([("S", i, float(i + 1)) for i in range(30)], "series string, day long, close double")
    assert rows(ft.rsi(df), "rsi")[-1] == 100.0


def test_hurst_of_a_walk(spark):
    rng = np.random.default_rng(1)
    walk = np.cumsum(rng.normal(size=4000))
    assert ft.hurst_value(walk.tolist()) == pytest.approx(0.5, abs=0.07)
    assert ft.hurst_value([1.0] * 19) is None


@pytest.mark.parametrize("rule", [lambda d: st.ma_trend_filter(d, 20), lambda d: st.donchian_breakout(d, 20, 10), lambda d: st.mean_reversion(d, 10, 1.0), lambda d: st.tsmom(d, 10, n=10), lambda d: st.vwap_reversion(d, 10, 1.0)])
def test_positions_do_not_look_ahead(spark, walk, rule):
    whole = rows(rule(spark.createDataFrame(walk)).select("day", "position"), "position")
    part = rows(rule(spark.createDataFrame(walk[:90])).select("day", "position"), "position")
    same([None if v is None or v != v else v for v in part], [None if v is None or v != v else v for v in whole[:90]])


def test_backtest_by_hand(spark):
    df = spark.createDataFrame([("S", 0, 100.0, 1.0), ("S", 1, 110.0, 1.0), ("S", 2, 99.0, 0.0), ("S", 3, 99.0, 0.0)], "series string, day long, close double, position double")
    r = bt.run(df, cost_bps=100, slippage_bps=0).orderBy("day").collect()
    assert [x["traded"] for x in r] == [0, 1, 1, 0]
    same([x["net"] for x in r], [0, 0.1 - 0.01, -0.1, -0.01])
    assert bt.look_ahead(bt.run(df)).count() == 0


def test_walk_forward_blocks_are_anchored(spark, walk):
    d = bt.anchored_blocks(spark.createDataFrame(walk), 4, ["series"])
    assert [r["n"] for r in d.groupBy("block").agg(F.count("*").alias("n")).orderBy("block").collect()] == [32] * 5


def test_stats_match_numpy(spark):
    x = np.random.default_rng(7).normal(0.002, 0.02, 500)
    df = spark.createDataFrame([("S", i, float(v)) for i, v in enumerate(x)], "series string, day long, net double")
    s = bt.stats(df, ["series"]).first()
    assert s["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(365))
    assert s["var5"] == pytest.approx(np.quantile(x, 0.05))
    assert s["skew"] == pytest.approx(pd.Series(x).skew())
    assert s["kurt"] == pytest.approx(pd.Series(x).kurt() + 3)
    e = np.cumprod(1 + x)
    assert s["max_drawdown"] == pytest.approx((e / np.maximum.accumulate(np.concatenate([[1], e]))[1:] - 1).min())


def test_pbo_of_noise_is_middling(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(f"s{j}", i, v) for j in range(8) for i, v in enumerate(rng.normal(0, 0.01, 240))], columns=["strategy", "day", "net"])
    r = bt.pbo(spark.createDataFrame(pdf)).first()
    assert r["combos"] == 70 and 0.0 <= r["pbo"] <= 1.0
    null = bt.null_pbos(spark, rng.normal(0, 0.01, (120, 4)), 6, 4)
    assert null.count() == 6


def test_lock_box():
    box = bt.LockBox()
    assert box.evaluate("a", lambda: 1) == 1
    with pytest.raises(RuntimeError):
        box.evaluate("a", lambda: 1)


def test_short_vol_is_a_stub():
    with pytest.raises(NotImplementedError):
        st.short_vol()


def column(spark, df, name="position"):
    return [r[name] for r in df.orderBy("day").collect()]


def test_carry_by_hand(spark):
    """Smoothing over one row, so that the rate is the figure: out and in are two rows."""
    rates = [0.2, -0.2, -0.3, 0.0, 0.08, 0.11, 0.06, 0.05]
    df = spark.createDataFrame([("S", i, r) for i, r in enumerate(rates)], "series string, day long, rate double")
    assert column(spark, st.carry(df, smooth=1, per_year=1)) == [-1, 0, 1, 0, 0, -1, -1, 0]
    assert column(spark, st.carry(df, smooth=1, per_year=1, inversion=False)) == [-1, 0, 0, 0, 0, -1, -1, 0]


def test_fixed_r_exit_by_hand(spark):
    """Range 1 every day: stop 2 below, goal 6 above; in again on the row after the stop, as the signal holds."""
    closes = [100.0, 100.0, 100.5, 98.0, 98.0, 99.0, 104.5, 104.5, 104.5]
    rows = [("S", i, c, c + 0.5, c - 0.5, 0.7 if i < 8 else 0.0) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "series string, day long, close double, high double, low double, position double")
    got = column(spark, st.fixed_r_exit(df, k=0.5, rr=2.0, n=2))
    assert got[0] == 0 and set(got) <= {0.0, 1.0} and got[-1] == 0 and 0.0 in got[2:5]


def test_donchian_takes_one_step_a_row(spark):
    closes = [10, 10, 10, 12, 12, 7, 7, 6, 6]
    rows = [("S", i, float(c), float(c), float(c)) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "series string, day long, close double, high double, low double")
    assert column(spark, st.donchian_breakout(df, 3, 2)) == [0, 0, 0, 1, 1, 0, 0, -1, -1]


def test_pairs_enters_beyond_the_stop_and_steps_once(spark):
    rng = np.random.default_rng(2)
    ly = np.cumsum(rng.normal(0, 0.01, 200))
    lx = ly + rng.normal(0, 0.01, 200)
    df = spark.createDataFrame([("S", i, float(np.exp(a)), float(np.exp(b))) for i, (a, b) in enumerate(zip(lx, ly))], "series string, day long, x double, y double")
    got = [r["position"] for r in st.pairs(df, n=20, entry=1.0, leave=0.3).orderBy("day").collect()]
    known = [g for g in got if g is not None and g == g]
    assert len(known) > 100 and all(a == 0 or b == 0 or a == b for a, b in zip(known, known[1:]))
