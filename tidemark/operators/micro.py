"""Microstructure econometrics of price changes: autocovariances, the MA(1) gate, Roll's spread, random-walk variance, bounds.

Only second moments leave the cluster: estimators are closed forms of the autocovariances. Estimates
abstain (NULL with a verdict) where the gate fails.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.scalars import chi2_quantile
from tidemark.functions.windows import by, previous, ratio


def autocovariances(df: DataFrame, most: int = 10, x: str = "dp", keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """keys, n, g (array: biased autocovariances of lags 0..most)."""
    keys = keys or ["series"]
    d = df.filter(F.col(x).isNotNull())
    # No equality join: it would lose a series whose key is NULL.
    d = d.withColumn("_e", F.col(x) - F.avg(x).over(by(keys, ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # One frame for all lags: each lag() reads the series again, with a buffer for every file the window has spilled.
    d = d.withColumn("_l", F.collect_list("_e").over(by(keys, ts).rowsBetween(-most, 0)))
    d = d.withColumns({f"_c{k}": F.col("_e") * F.try_element_at("_l", F.lit(-1 - k)) for k in range(most + 1)})
    return d.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"_c{k}").alias(f"_c{k}") for k in range(most + 1)]).select(*keys, "n", F.array(*[F.coalesce(F.col(f"_c{k}") / F.col("n"), F.lit(0.0)) for k in range(most + 1)]).alias("g"))


def acf(gammas: DataFrame) -> DataFrame:
    return gammas.withColumn("acf", F.transform("g", lambda v: F.try_divide(v, F.element_at("g", 1))))


def ma1_gate(gammas: DataFrame, most: int = 10, alpha: float = 0.05) -> DataFrame:
    """Add q (summed squared autocorrelations beyond lag 1, scaled by their variance under an MA(1)), critical and passes."""
    rho = lambda k: F.try_divide(F.element_at("g", k + 1), F.element_at("g", 1))
    n, lags = F.col("n"), range(2, most + 1)
    # Bartlett: n cov(r_k, r_k+d) is the sum of rho_j rho_j+d over all j, which under an MA(1) leaves terms for d up to 2.
    by_distance = [1 + 2 * rho(1) ** 2, 2 * rho(1), rho(1) ** 2]
    q = sum((rho(k) ** 2 * n * (n + 2) / (n - k) for k in lags), F.lit(0.0)) / by_distance[0]
    # q has mean len(lags) and variance twice the sum of all squared correlations of its terms: a scaled chi-square with both.
    spread = sum((F.lit(float(len(lags) - d) * (2 if d else 1)) * (c / by_distance[0]) ** 2 for d, c in enumerate(by_distance) if d < len(lags)), F.lit(0.0))
    g = gammas.withColumns({"q": q, "_c": spread / len(lags)})
    df = len(lags) / F.col("_c")

    @F.pandas_udf(DoubleType())
    def critical(v):
        return v.map(lambda x: chi2_quantile(1 - alpha, x) if x == x and x > 0 else math.nan)

    return g.withColumn("critical", F.col("_c") * critical(df)).withColumn("passes", F.col("q") <= F.col("critical")).drop("_c")


def roll(gammas: DataFrame, force: bool = False, **gate) -> DataFrame:
    """Half-spread c from the first autocovariance, the random walk's variance and its alternatives, with a verdict."""
    g = ma1_gate(gammas, **gate)
    g0, g1 = F.element_at("g", 1), F.element_at("g", 2)
    ok = (F.col("passes") | F.lit(force)) & (g1 < 0)
    verdict = F.when(~F.col("passes") & ~F.lit(force), "abstain: not MA(1)").when(g1 >= 0, "abstain: first autocovariance not negative").otherwise("ok")
    # An MA(1) with these moments has theta s2 = g1 and (1 + theta^2) s2 = g0; it exists if the discriminant is not negative.
    inside = g0**2 - 4 * g1**2
    whole = (F.col("passes") | F.lit(force)) & (inside >= 0)
    s2 = (g0 + F.sqrt(inside)) / 2  # of the invertible one
    theta = ratio(g1, s2)
    bound = (g0 - F.sqrt(inside)) / 2
    return g.withColumns({
        "verdict": verdict, "c": F.when(ok, F.sqrt(-g1)), "sigma2_w": F.when(ok, g0 + 2 * g1), "theta": F.when(whole, theta), "sigma2_wold": F.when(whole, (1 + theta) ** 2 * s2),
        "bound": F.when(whole, bound), "c_low": F.when(ok & whole, F.sqrt(F.greatest(bound, F.lit(0.0)))), "c_high": F.when(ok & whole, F.sqrt(-g1)),
    })


def variance_intercept(df: DataFrame, ks: list[int], x: str = "p", keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Random-walk variance as the intercept of Var(k-step change) / k on 1 / k."""
    keys = keys or ["series"]
    w = by(keys, ts)
    d = df.withColumns({f"_d{k}": F.col(x) - F.lag(x, k).over(w) for k in ks})
    g = d.groupBy(*keys).agg(*[F.var_samp(f"_d{k}").alias(f"_v{k}") for k in ks])
    rows = g.select(*keys, F.explode(F.array(*[F.struct(F.lit(1.0 / k).alias("x"), (F.col(f"_v{k}") / k).alias("y")) for k in ks])).alias("s")).select(*keys, "s.*")
    return rows.groupBy(*keys).agg(F.regr_intercept("y", "x").alias("sigma2_w"), F.regr_slope("y", "x").alias("slope"))


def yule_walker(g: list[float], k: int) -> np.ndarray:
    """AR(k) coefficients from autocovariances."""
    g = np.asarray(g, float)
    return np.linalg.solve(g[np.abs(np.subtract.outer(range(k), range(k)))], g[1 : k + 1])


def sigma2_ar(g: list[float], k: int) -> float:
    """Random-walk variance from an AR(k): innovation variance over (1 - sum of coefficients) squared."""
    phi = yule_walker(g, k)
    return float((g[0] - phi @ np.asarray(g[1 : k + 1])) / (1 - phi.sum()) ** 2)


def impulse_response(phi: np.ndarray, horizon: int = 20) -> list[float]:
    """Cumulative response to a unit shock."""
    psi = [1.0]
    for h in range(1, horizon + 1):
        psi.append(sum(phi[j] * psi[h - 1 - j] for j in range(min(len(phi), h))))
    return np.cumsum(psi).tolist()


def ar_variance(gammas: DataFrame, k: int) -> DataFrame:
    """Add sigma2_ar; a grouped solve of k x k systems from the moments."""

    @F.pandas_udf(DoubleType())
    def solve(g):
        return g.map(lambda v: sigma2_ar(v, k))

    return gammas.withColumn("sigma2_ar", solve("g"))


def by_blocks(df: DataFrame, blocks: int, most: int = 10, x: str = "dp", ts: str = "ts") -> DataFrame:
    """Roll's c by blocks of equal rows: mean, standard error, and the number of blocks that abstained."""
    from pyspark.sql import Window

    d = df.withColumn("block", F.ntile(blocks).over(Window.partitionBy("series").orderBy(ts)))
    r = roll(autocovariances(d, most, x, ["series", "block"], ts), most=most, force=True)
    return r.groupBy("series").agg(F.count("c").alias("used"), F.count(F.when(F.col("c").isNull(), 1)).alias("skipped"), F.avg("c").alias("mean"), (F.stddev_samp("c") / F.sqrt(F.count("c"))).alias("se"))


def segment_moments(df: DataFrame, gap: int, x: str = "sign", order: str = "id") -> DataFrame:
    """Pooled first and second moments of a series cut where the id jumps by more than gap or the hour changes: n0, s0, ssq, n1, s1."""
    d = previous(df.withColumn("_own", F.struct(F.col(order).alias("o"), F.col("hour").alias("h"), F.col(x).alias("x"))), "_was", "_own", ["exchange"], order, 1_000_000)
    cut = (F.col(order) - F.col("_was.o") > gap) | (F.col("hour") != F.col("_was.h"))
    d = d.withColumn("_p", F.when(~F.coalesce(cut, F.lit(True)), F.col("_was.x")))
    return d.groupBy("exchange", "day").agg(F.count(x).alias("n0"), F.sum(x).alias("s0"), F.sum(F.col(x) ** 2).alias("ssq"), F.count("_p").alias("n1"), F.sum(F.col(x) * F.col("_p")).alias("s1"))
