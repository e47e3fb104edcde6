"""Option chains: Black-76 greeks, implied volatilities at strikes and deltas, term structure, max pain, gamma.

A chain has expiry_days, strike, opt_type (C or P), iv, oi and forward. One expiry's ladder fits a
task by nature (some hundred strikes), so ladders are handled by grouped functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import norm_cdf
from tidemark.functions.windows import ratio

PDF = 1 / math.sqrt(2 * math.pi)


def cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def d1(f: Column, k: Column, iv: Column, t: Column) -> Column:
    good = (f > 0) & (k > 0) & (iv > 0) & (t > 0)
    return F.when(good, (F.log(f / k) + iv**2 * t / 2) / (iv * F.sqrt(t)))


def greeks(df: DataFrame, r: float = 0.0) -> DataFrame:
    """Add delta, gamma, vega; degenerate rows stay NULL. df has forward, strike, iv, t (years), opt_type."""
    df = df.withColumn("_d1", d1(F.col("forward"), F.col("strike"), F.col("iv"), F.col("t")))
    df = df.withColumn("_n", norm_cdf("_d1"))
    disc = F.exp(-r * F.col("t"))
    density = PDF * F.exp(-F.col("_d1") ** 2 / 2)
    return df.withColumns({
        "delta": disc * (F.col("_n") - F.when(F.col("opt_type") == "P", 1.0).otherwise(0.0)), "gamma": disc * density / (F.col("forward") * F.col("iv") * F.sqrt("t")), "vega": disc * F.col("forward") * density * F.sqrt("t"),
    }).drop("_d1", "_n")


def with_forward(chain: DataFrame, underlying: str | None = None) -> DataFrame:
    """Add forward (median underlying of the expiry, else the median strike) and t."""
    f = chain.groupBy("expiry_days").agg(F.percentile("strike", F.lit(0.5)).alias("_k"), *([F.percentile(underlying, F.lit(0.5)).alias("_u")] if underlying else []))
    forward = F.coalesce("_u", "_k") if underlying else F.col("_k")
    return chain.join(F.broadcast(f.select("expiry_days", forward.alias("forward"))), "expiry_days").withColumn("t", F.col("expiry_days") / 365)


def otm_ladder(chain: DataFrame) -> DataFrame:
    """Mean iv of each strike from the out-of-the-money side; an expiry that has none takes all."""
    good = chain.filter((F.col("iv") > 0) & (F.col("strike") > 0))
    otm = F.when(F.col("opt_type") == "C", F.col("strike") >= F.col("forward")).otherwise(F.col("strike") <= F.col("forward"))
    has = good.groupBy("expiry_days").agg(F.max(otm.cast("int")).alias("_has"))
    return good.join(F.broadcast(has), "expiry_days").filter(otm | (F.col("_has") == 0)).groupBy("expiry_days", "strike").agg(F.avg("iv").alias("iv"), F.first("forward").alias("forward"), F.first("t").alias("t"))


def pchip(x: np.ndarray, y: np.ndarray, at: float) -> float:
    """Monotone cubic interpolation (weighted harmonic slopes), clamped at the ends; linear under three points."""
    if at <= x[0]:
        return float(y[0])
    if at >= x[-1]:
        return float(y[-1])
    if len(x) < 3:
        return float(np.interp(at, x, y))
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = d[:-1] * d[1:] > 0
    m[1:-1][same] = (w1 + w2)[same] / (w1[same] / d[:-1][same] + w2[same] / d[1:][same])
    for end, near, far, h0, h1 in ((0, d[0], d[1], h[0], h[1]), (-1, d[-1], d[-2], h[-1], h[-2])):
        s = ((2 * h0 + h1) * near - h0 * far) / (h0 + h1)
        m[end] = 0.0 if s * near <= 0 else 3 * near if near * far < 0 and abs(s) > 3 * abs(near) else s
    i = int(np.searchsorted(x, at) - 1)
    u, w = (at - x[i]) / h[i], h[i]
    return float((1 + 2 * u) * (1 - u) ** 2 * y[i] + u * (1 - u) ** 2 * w * m[i] + u**2 * (3 - 2 * u) * y[i + 1] + u**2 * (u - 1) * w * m[i + 1])


def call_delta(f: float, k: float, iv: float, t: float) -> float:
    return cdf((math.log(f / k) + iv * iv * t / 2) / (iv * math.sqrt(t))) if min(f, k, iv, t) > 0 else math.nan


def strike_for_delta(x: np.ndarray, y: np.ndarray, f: float, t: float, target: float, points: int = 200) -> float:
    """Strike whose call delta crosses the target on an even grid, linearly between points; else the nearest."""
    grid = np.linspace(x[0], x[-1], points)
    delta = np.array([call_delta(f, k, pchip(x, y, k), t) for k in grid]) - target
    cross = np.flatnonzero(delta[:-1] * delta[1:] <= 0)
    if len(cross) and delta[cross[0]] != delta[cross[0] + 1]:
        i = cross[0]
        return float(grid[i] + (grid[i + 1] - grid[i]) * delta[i] / (delta[i] - delta[i + 1]))
    return float(grid[np.nanargmin(np.abs(delta))])


def surface(chain: DataFrame) -> DataFrame:
    """One row for each expiry: atm_iv at the forward and skew_25d (iv of the 25-delta call minus that of the put)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("strike")
        x, y, f, t = g["strike"].to_numpy(), g["iv"].to_numpy(), float(g["forward"].iloc[0]), float(g["t"].iloc[0])
        skew = math.nan
        if len(x) >= 3 and t > 0:
            skew = pchip(x, y, strike_for_delta(x, y, f, t, 0.25)) - pchip(x, y, strike_for_delta(x, y, f, t, 0.75))
        return pd.DataFrame({"expiry_days": [g["expiry_days"].iloc[0]], "t": [t], "forward": [f], "atm_iv": [pchip(x, y, f)], "skew_25d": [skew]})

    return otm_ladder(chain).groupBy("expiry_days").applyInPandas(run, "expiry_days int, t double, forward double, atm_iv double, skew_25d double")


def smile(chain: DataFrame, drop_wing: float = 0.05) -> DataFrame:
    """Out-of-the-money points by log-moneyness, strike and delta, wings within drop_wing of delta 0 or 1 left out."""
    l = otm_ladder(chain).withColumn("opt_type", F.lit("C"))  # noqa: E741
    g = greeks(l).filter(F.col("delta").between(drop_wing, 1 - drop_wing))
    return g.select("expiry_days", "strike", F.log(F.col("strike") / F.col("forward")).alias("log_moneyness"), "delta", "iv")


def max_pain(chain: DataFrame) -> DataFrame:
    """Strike of each expiry at which all open interest is worth least (the lowest on a tie), and put over call interest.

    Pain at a strike is linear in running sums over the sorted strikes, so no strike meets every other.
    """
    from pyspark.sql import Window

    call, put = (F.sum(F.when(F.col("opt_type") == k, F.col("oi")).otherwise(0.0)) for k in "CP")
    k = chain.groupBy("expiry_days", "strike").agg(call.alias("c"), put.alias("p"))
    w = Window.partitionBy("expiry_days").orderBy("strike")
    below, above = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    s = F.col("strike")
    pain = s * zero(F.sum("c").over(below)) - zero(F.sum(F.col("c") * s).over(below)) + zero(F.sum(F.col("p") * s).over(above)) - s * zero(F.sum("p").over(above))
    g = k.withColumn("pain", F.round(pain, 6))
    return g.groupBy("expiry_days").agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), ratio(F.sum("p"), F.sum("c")).alias("put_call"))


def gamma_concentration(chain: DataFrame) -> DataFrame:
    """Absolute gamma times open interest by strike."""
    return greeks(chain).filter("gamma is not null").groupBy("expiry_days", "strike").agg(F.sum(F.abs("gamma") * F.col("oi")).alias("gamma_oi"))


def iv_at(term: DataFrame, target: float) -> DataFrame:
    """iv at `target` years, linear in total variance between the two nearest expiries, clamped; and the nearest expiry."""
    v = F.col("atm_iv") ** 2 * F.col("t")
    g = term.filter("t > 0 and atm_iv is not null").agg(
        F.max_by(F.struct("t", v.alias("v")), F.when(F.col("t") <= target, F.col("t"))).alias("lo"), F.min_by(F.struct("t", v.alias("v")), F.when(F.col("t") >= target, F.col("t"))).alias("hi"),
        F.min_by("expiry_days", F.struct(F.abs(F.col("t") - target), "t")).alias("nearest"),
    )
    mix = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * F.coalesce(F.try_divide(target - F.col("lo.t"), F.col("hi.t") - F.col("lo.t")), F.lit(0.0))
    clamp = lambda x: F.sqrt(F.col(f"{x}.v") / F.col(f"{x}.t"))
    return g.select(F.when(F.col("lo").isNull(), clamp("hi")).when(F.col("hi").isNull(), clamp("lo")).otherwise(F.sqrt(mix / target)).alias("iv"), "nearest")


#: Month abbreviations of instrument names; fixed.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
NAME = r"^([A-Z0-9]+)-([0-9]{1,2})([A-Z]{3})([0-9]{2})-([0-9]+(?:d[0-9]+)?)-([CP])$"


def parse_instrument(name: Column) -> Column:
    """(currency, expiry_ms at 08:00 UTC, strike, opt_type) of CCY-DMMMYY-STRIKE-C|P, NULL if it is not one."""
    part = lambda i: F.regexp_extract(name, NAME, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(3))
    day = F.try_to_date(F.format_string("20%s-%02d-%02d", part(4), month, F.coalesce(part(2).try_cast("int"), F.lit(0))), "yyyy-MM-dd")
    expiry = F.unix_date(day).cast("long") * 86_400_000 + 8 * 3_600_000
    return F.when(name.rlike(NAME) & (month > 0) & day.isNotNull(), F.struct(part(1).alias("currency"), expiry.alias("expiry_ms"), F.regexp_replace(part(5), "d", ".").try_cast("double").alias("strike"), part(6).alias("opt_type")))
