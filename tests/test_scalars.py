"""Scalars against known values and recovered truths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import micro, options as op, risk


def test_distributions():
    assert sc.chi2_quantile(0.95, 10) == pytest.approx(18.307, rel=2e-3)
    assert math.erf(sc.erf_inverse(0.3)) == pytest.approx(0.3)
    assert sc.expected_max_sharpe(1) == 0
    assert sc.expected_max_sharpe(10) == pytest.approx(1.5746, abs=2e-3)
    assert sc.probabilistic_sharpe(0.1, 1000, 0, 3) == pytest.approx(0.99917, abs=2e-4)
    assert sc.deflated_sharpe(0.1, 1000, 0, 3, 10, 0.0025) < sc.probabilistic_sharpe(0.1, 1000, 0, 3)
    sr = sc.false_strategy_threshold(10, 0.0025, 1000, 0, 3)
    assert sc.deflated_sharpe(sr, 1000, 0, 3, 10, 0.0025) == pytest.approx(0.95, abs=1e-6)
    assert sc.probability_false_strategy(sr, 10, 0.0025, 1000, 0, 3) == pytest.approx(0.05, abs=1e-6)
    assert sc.kelly(0.6, 1) == pytest.approx(0.2) and sc.kelly_fraction(0.1, 0.2) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        sc.kelly(1.2, 1)


def test_bars_and_months():
    assert sc.bar_ms("1h") == 3_600_000 and sc.periods_per_year("1d") == 365
    for bad in ("7m", "0h", "h", "1w", "5h"):
        with pytest.raises(ValueError):
            sc.bar_ms(bad)
    assert sc.month_bounds("2024-12")[1] - sc.month_bounds("2024-12")[0] == 31 * 86_400_000


def test_erf_series(spark):
    got = spark.createDataFrame([(x / 4,) for x in range(-8, 9)], "x double").select("x", sc.erf_series(F.col("x")).alias("e"), sc.norm_cdf("x").alias("n")).collect()
    assert all(abs(r["e"] - math.erf(r["x"])) < 2e-7 for r in got)
    assert all(r["n"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2))) for r in got)


def test_put_call_parity_of_delta(spark):
    df = spark.createDataFrame([("C", 100.0, 90.0, 0.5, 0.25), ("P", 100.0, 90.0, 0.5, 0.25), ("C", 100.0, 90.0, 0.0, 0.25)], "opt_type string, forward double, strike double, iv double, t double")
    c, p, bad = op.greeks(df).orderBy(F.desc("iv"), "opt_type").collect()
    assert c["delta"] - p["delta"] == pytest.approx(1.0) and c["gamma"] == pytest.approx(p["gamma"]) and bad["delta"] is None


def test_pchip_keeps_monotone_and_points():
    x, y = np.array([1.0, 2, 4, 7]), np.array([1.0, 3, 3.5, 9])
    assert [op.pchip(x, y, v) for v in x] == pytest.approx(y.tolist())
    fine = [op.pchip(x, y, v) for v in np.linspace(0, 8, 200)]
    assert all(b >= a - 1e-12 for a, b in zip(fine, fine[1:]))
    assert op.pchip(x[:2], y[:2], 1.5) == pytest.approx(2.0)


def test_instrument_names(spark):
    names = ["BTC-4JAN25-100000-C", "ETH-28FEB25-0d5-P", "BTC-PERPETUAL", "BTC-31FEB25-1-C", "BTC-4XYZ25-1-C"]
    got = {r["n"]: r["i"] for r in spark.createDataFrame([(n,) for n in names], "n string").withColumn("i", op.parse_instrument(F.col("n"))).collect()}
    assert got[names[0]]["strike"] == 100000 and got[names[0]]["expiry_ms"] == 1_735_977_600_000
    assert got[names[1]]["strike"] == 0.5
    assert got[names[2]] is None and got[names[3]] is None and got[names[4]] is None


def test_roll_recovers_the_spread(spark):
    rng = np.random.default_rng(0)
    n, c = 20_000, 0.5
    p = np.cumsum(rng.normal(0, 0.2, n)) + c * rng.choice([-1, 1], n)
    df = spark.createDataFrame([("S", i, float(v)) for i, v in enumerate(np.diff(p))], "series string, ts long, dp double")
    r = micro.roll(micro.autocovariances(df, 10)).first()
    assert r["verdict"] == "ok" and r["c"] == pytest.approx(c, rel=0.05) and r["sigma2_w"] == pytest.approx(0.04, rel=0.4)
    assert micro.ar_variance(micro.autocovariances(df, 10), 10).first()["sigma2_ar"] == pytest.approx(0.04, rel=0.5)
    assert micro.impulse_response(np.array([0.5]), 3) == pytest.approx([1, 1.5, 1.75, 1.875])


def test_tail_fit_recovers_shape(spark):
    rng = np.random.default_rng(5)
    x = -(0.02 / 0.2) * ((1 - rng.random(40_000)) ** -0.2 - 1)
    df = spark.createDataFrame([("S", float(v)) for v in x], "series string, net double")
    r = risk.evt_tail(df, ["series"]).first()
    assert r["xi"] == pytest.approx(0.2, abs=0.1) and -r["es"] > -r["var"] > r["u"] > 0
