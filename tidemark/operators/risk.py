"""Risk statistics across strategies: tails, shrinkage, effective trials, information coefficients."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.functions.windows import average_rank, by, finite, ratio


def evt_tail(returns: DataFrame, keys: list[str], r: str = "net", threshold_q: float = 0.95, alpha: float = 0.99, least: int = 30) -> DataFrame:
    """Losses beyond a quantile fitted by probability-weighted moments: xi, beta, and var and es as returns (losses are negative); NULL under `least` exceedances, for an alpha inside the body and for a degenerate fit."""
    d = returns.filter(F.col(r).isNotNull()).withColumn("_l", -F.col(r))
    u = d.groupBy(*keys).agg(F.percentile("_l", F.lit(threshold_q)).alias("u"), F.count("*").alias("n"))
    x = d.join(u, keys).filter(F.col("_l") > F.col("u")).withColumn("x", F.col("_l") - F.col("u"))
    w = Window.partitionBy(*keys)
    x = x.withColumns({"_i": F.row_number().over(w.orderBy("x")), "_m": F.count("*").over(w)})
    g = x.groupBy(*keys).agg(F.max("_m").alias("exceed"), F.max("u").alias("u"), F.max("n").alias("n"), F.avg("x").alias("a0"), F.avg(F.col("x") * F.try_divide(F.col("_m") - F.col("_i"), F.col("_m") - 1)).alias("a1"))
    enough, gap = F.col("exceed") >= least, F.col("a0") - 2 * F.col("a1")
    beyond = F.lit(1 - alpha) <= F.col("exceed") / F.col("n")  # alpha lies in the fitted tail
    xi, beta = 2 - F.col("a0") / gap, 2 * F.col("a0") * F.col("a1") / gap
    ok = enough & beyond & (gap > 0) & (beta > 0)
    g = g.withColumns({"xi": F.when(ok, xi), "beta": F.when(ok, beta), "u": F.when(enough, F.col("u"))})
    tail = (1 - alpha) / (F.col("exceed") / F.col("n"))
    var = F.when(F.abs("xi") < 1e-9, F.col("u") - F.col("beta") * F.log(tail)).otherwise(F.col("u") + F.col("beta") / F.col("xi") * (F.pow(tail, -F.col("xi")) - 1))
    g = g.withColumn("var", var)
    es = F.when(F.col("xi") < 1, (F.col("var") + F.col("beta") - F.col("xi") * F.col("u")) / (1 - F.col("xi")))
    return g.select(*keys, "n", "exceed", "u", "xi", "beta", (-F.col("var")).alias("var"), (-es).alias("es"))


def effective_trials(returns: DataFrame, r: str = "net", strategy: str = "strategy", ts: str = "day") -> DataFrame:
    """n and n_eff = n^2 / sum of squared correlations, which is the participation ratio of the correlation's eigenvalues."""
    a = returns.select(ts, F.col(strategy).alias("a"), F.col(r).alias("x"))
    b = returns.select(ts, F.col(strategy).alias("b"), F.col(r).alias("y"))
    c = a.join(b, ts).groupBy("a", "b").agg(finite(F.corr("x", "y")).alias("c"))
    return c.agg(F.countDistinct("a").alias("n"), ratio(F.pow(F.countDistinct("a").cast("double"), 2), F.sum(F.col("c") ** 2)).alias("n_eff"))


def shrunk_sharpes(stats: DataFrame, sharpe: str = "sharpe", variance: str = "variance", key: str = "strategy") -> DataFrame:
    """DerSimonian-Laird shrinkage of Sharpe ratios towards their weighted mean."""
    s = stats.filter(F.col(variance) > 0).withColumn("_w", 1 / F.col(variance))
    m = s.agg(F.sum("_w").alias("sw"), F.sum(F.col("_w") ** 2).alias("sw2"), (F.sum(F.col("_w") * F.col(sharpe)) / F.sum("_w")).alias("mu"), F.count("*").alias("k"))
    q = s.crossJoin(F.broadcast(m)).agg(F.sum(F.col("_w") * (F.col(sharpe) - F.col("mu")) ** 2).alias("q"))  # one row each
    m = m.crossJoin(F.broadcast(q)).withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("sw") - F.col("sw2") / F.col("sw")), F.lit(0.0))))
    s = s.crossJoin(F.broadcast(m.select("tau2"))).withColumn("_v", 1 / (F.col(variance) + F.col("tau2")))
    mu = s.agg((F.sum(F.col("_v") * F.col(sharpe)) / F.sum("_v")).alias("mu"))
    out = s.crossJoin(F.broadcast(mu))
    weight = F.col("tau2") / (F.col("tau2") + F.col(variance))
    return out.select(key, sharpe, "tau2", "mu", (F.col("mu") + weight * (F.col(sharpe) - F.col("mu"))).alias("shrunk"))


def deflated(stats: DataFrame, n_trials: int, year: float = 365) -> DataFrame:
    """Add psr, dsr and variance of each row of backtest.stats(); the trials' variance is that of their Sharpe ratios a period."""
    sr = F.col("sharpe") / math.sqrt(year)
    s = stats.withColumn("sr", sr)
    v = s.agg(F.var_samp("sr").alias("_vt"))
    s = s.crossJoin(F.broadcast(v))  # one row
    s = s.withColumn("variance", (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2) / (F.col("n") - 1))
    bar = F.sqrt("_vt") * sc.expected_max_sharpe(n_trials)
    z = lambda b: F.try_divide(F.col("sr") - b, F.sqrt("variance"))
    return s.withColumns({"_zp": z(F.lit(0.0)), "_zd": z(bar)}).withColumns({"psr": sc.norm_cdf("_zp"), "dsr": sc.norm_cdf("_zd")}).drop("_zp", "_zd", "_vt")


# -- information coefficients


def forward_returns(df: DataFrame, k: int = 1, price: str = "close", series: str = "series", ts: str = "day") -> DataFrame:
    w = by(series, ts)
    return df.withColumn("fwd", ratio(F.lead(price, k).over(w), F.col(price)) - 1)


def information_coefficient(df: DataFrame, keys: list[str], signal: str = "signal", fwd: str = "fwd", method: str = "spearman", least: int = 3) -> DataFrame:
    """ic of each key: correlation of signal and forward return, of their average ranks for spearman."""
    d = df.filter(F.col(signal).isNotNull() & F.col(fwd).isNotNull()).select(*keys, F.col(signal).alias("_x"), F.col(fwd).alias("_y"))
    if method == "spearman":
        d = d.withColumns({"_x": average_rank(F.col("_x"), keys), "_y": average_rank(F.col("_y"), keys)})
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, finite(F.corr("_x", "_y"))).alias("ic"))


def ic_profile(df: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10), signal: str = "signal", **kw) -> DataFrame:
    out = None
    for k in horizons:
        one = information_coefficient(forward_returns(df, k), ["series"], signal, **kw).withColumn("horizon", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def ic_blocks(df: DataFrame, block: int = 21, k: int = 1, signal: str = "signal", method: str = "spearman") -> DataFrame:
    """Mean, deviation, ratio and t of the ICs of whole blocks of rows whose signal and forward return are known."""
    d = forward_returns(df, k).filter(F.col(signal).isNotNull() & F.col("fwd").isNotNull())
    d = d.withColumn("block", F.floor((F.row_number().over(by("series", "day")) - 1) / block))
    ics = information_coefficient(d, ["series", "block"], signal, method=method).filter((F.col("n") == block) & F.col("ic").isNotNull())
    return ics.groupBy("series").agg(F.count("*").alias("blocks"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ir"), (ratio(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("*"))).alias("t"))


def ic_significance(df: DataFrame, k: int = 1, signal: str = "signal") -> DataFrame:
    """Regression of the forward return's ranks on the signal's, with Newey-West errors of k - 1 lags: slope, t, p."""
    d = forward_returns(df, k).filter(F.col(signal).isNotNull() & F.col("fwd").isNotNull())
    d = d.withColumns({"_x": average_rank(F.col(signal), ["series"]), "_y": average_rank(F.col("fwd"), ["series"])})
    m = d.groupBy("series").agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.regr_slope("_y", "_x").alias("slope"), F.regr_sxx("_y", "_x").alias("_sxx"), F.count("*").alias("n"))
    d = d.join(m, "series")
    d = d.withColumn("_u", (F.col("_x") - F.col("_mx")) * (F.col("_y") - F.col("_my") - F.col("slope") * (F.col("_x") - F.col("_mx"))))
    w = by("series", "day")
    d = d.withColumns({f"_c{j}": F.col("_u") * F.lag("_u", j).over(w) for j in range(1, k)})
    terms = [F.sum(F.col("_u") ** 2)] + [2 * (1 - j / k) * F.sum(f"_c{j}") for j in range(1, k)]
    g = d.groupBy("series").agg(F.first("n").alias("n"), F.first("slope").alias("slope"), F.first("_sxx").alias("_sxx"), sum(terms[1:], terms[0]).alias("_s"))
    g = g.withColumn("t", ratio(F.col("slope") * F.col("_sxx"), F.sqrt("_s")))
    return g.withColumn("p", sc.erfc(F.abs("t") / math.sqrt(2))).drop("_s", "_sxx")


def regime_ic(df: DataFrame, mask: str = "mask", k: int = 1, signal: str = "signal", **kw) -> DataFrame:
    """The IC inside and outside a mask; an unknown mask is outside."""
    d = forward_returns(df, k).withColumn("regime", F.coalesce(F.col(mask), F.lit(False)))
    return information_coefficient(d, ["series", "regime"], signal, **kw)
