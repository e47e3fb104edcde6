"""Rolling features of price series. Input: one row per (series, ts), ordered by ts; warm-up rows stay NULL."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.windows import by, finite, prior, ratio, rolling, running

LN2 = math.log(2)


def simple_returns(p: Column, w) -> Column:
    return ratio(p, F.lag(p).over(w)) - 1


def log_returns(p: Column, w) -> Column:
    return F.when((p > 0) & (F.lag(p).over(w) > 0), F.log(p / F.lag(p).over(w)))


def momentum(p: Column, w, n: int) -> Column:
    return ratio(p, F.lag(p, n).over(w)) - 1


def sma(x: Column, w, n: int) -> Column:
    return rolling(F.avg, x, w, n)


def with_ewm(df: DataFrame, specs: dict[str, tuple[str, float, int]], series: str = "series", ts: str = "day") -> DataFrame:
    """Add exponential means: name -> (column, alpha, least number of values).

    Linear time: one series at a time in time order, so a series must fit one task. functions.windows.ewm is
    the same as a window expression that looks back a bounded number of rows.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in specs)])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(ts)
        return g.assign(**{name: g[c].astype(float).ewm(alpha=alpha, adjust=False, min_periods=least).mean() for name, (c, alpha, least) in specs.items()})

    return df.groupBy(series).applyInPandas(run, schema)


def ema(df: DataFrame, column: str, n: int, name: str = "ema", series: str = "series", ts: str = "day") -> DataFrame:
    return with_ewm(df, {name: (column, 2 / (n + 1), n)}, series, ts)


def zscore(x: Column, w, n: int) -> Column:
    return ratio(x - rolling(F.avg, x, w, n), rolling(F.stddev_samp, x, w, n))


def realized_vol(r: Column, w, n: int = 20, year: float = 365) -> Column:
    return rolling(F.stddev_samp, r, w, n) * math.sqrt(year)


def rolling_sharpe(r: Column, w, n: int = 90, year: float = 365) -> Column:
    return ratio(rolling(F.avg, r, w, n), rolling(F.stddev_samp, r, w, n)) * math.sqrt(year)


def drawdown(equity: Column, w) -> Column:
    return ratio(equity, running(F.max, equity, w)) - 1


def rolling_corr(a: Column, b: Column, w, n: int) -> Column:
    """Pearson over the pairs among the last n rows, NULL with fewer than n / 2."""
    pair = a.isNotNull() & b.isNotNull()
    x, y = F.when(pair, a), F.when(pair, b)
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= max(2, n / 2), finite(F.corr(x, y).over(frame)))


def return_features(df: DataFrame, price: str = "close", n: int = 20, series: str = "series", ts: str = "day") -> DataFrame:
    """Add ret, log_ret, vol, mom, mean, z, sharpe, dd."""
    w, p = by(series, ts), F.col(price)
    df = df.withColumns({"ret": simple_returns(p, w), "log_ret": log_returns(p, w), "mom": momentum(p, w, n), "mean": sma(p, w, n), "z": zscore(p, w, n), "dd": drawdown(p, w)})
    return df.withColumns({"vol": realized_vol(F.col("log_ret"), w, n), "sharpe": rolling_sharpe(F.col("ret"), w, n)})


def true_range(w) -> Column:
    before = F.lag("close").over(w)
    return F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(df: DataFrame, n: int = 14, series: str = "series", ts: str = "day") -> DataFrame:
    """Add tr and atr (Wilder's mean of the true range)."""
    w = by(series, ts)
    return with_ewm(df.withColumn("tr", true_range(w)), {"atr": ("tr", 1 / n, n)}, series, ts)


def rsi(df: DataFrame, n: int = 14, series: str = "series", ts: str = "day") -> DataFrame:
    """Add rsi; 100 where nothing fell, NULL in the warm-up."""
    w = by(series, ts)
    change = F.col("close") - F.lag("close").over(w)
    df = df.withColumns({"_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))})
    df = df.withColumns({k: F.when(change.isNotNull(), F.col(k)) for k in ("_up", "_down")})
    df = with_ewm(df, {"_au": ("_up", 1 / n, n), "_ad": ("_down", 1 / n, n)}, series, ts)
    value = F.when(F.col("_ad") == 0, 100.0).when(F.col("_ad").isNotNull(), 100 - 100 / (1 + ratio(F.col("_au"), F.col("_ad"))))
    return df.withColumn("rsi", value).drop("_up", "_down", "_au", "_ad")


def adx(df: DataFrame, n: int = 14, series: str = "series", ts: str = "day") -> DataFrame:
    """Add adx: Wilder's mean of the directional index."""
    w = by(series, ts)
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    df = df.withColumns({"_p": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)), "_m": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)), "_tr": true_range(w)})
    df = with_ewm(df, {f"_e{c}": (f"_{c}", 1 / n, n) for c in ("p", "m", "tr")}, series, ts)
    df = df.withColumns({"_p": 100 * ratio(F.col("_ep"), F.col("_etr")), "_m": 100 * ratio(F.col("_em"), F.col("_etr"))})
    df = df.withColumn("_dx", 100 * ratio(F.abs(F.col("_p") - F.col("_m")), F.col("_p") + F.col("_m")))
    return with_ewm(df, {"adx": ("_dx", 1 / n, n)}, series, ts).drop("_p", "_m", "_tr", "_dx", "_ep", "_em", "_etr")


def yang_zhang(df: DataFrame, n: int = 20, year: float = 365, series: str = "series", ts: str = "day") -> DataFrame:
    """Add yz: volatility from overnight, open-to-close and Rogers-Satchell parts."""
    w = by(series, ts)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    df = df.withColumns({"_on": F.log(o / F.lag(c).over(w)), "_oc": F.log(c / o), "_rs": F.log(h / c) * F.log(h / o) + F.log(l / c) * F.log(l / o)})
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = rolling(F.var_samp, F.col("_on"), w, n) + k * rolling(F.var_samp, F.col("_oc"), w, n) + (1 - k) * rolling(F.avg, F.col("_rs"), w, n)
    return df.withColumn("yz", F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)) * year))).drop("_on", "_oc", "_rs")


def donchian(df: DataFrame, n: int = 55, exit_n: int = 20, series: str = "series", ts: str = "day") -> DataFrame:
    """Add the channels of the n (entry) and exit_n rows before."""
    w = by(series, ts)
    return df.withColumns({"hi": prior(F.max, F.col("high"), w, n), "lo": prior(F.min, F.col("low"), w, n), "exit_hi": prior(F.max, F.col("high"), w, exit_n), "exit_lo": prior(F.min, F.col("low"), w, exit_n)})


def vwap_bands(df: DataFrame, n: int = 48, series: str = "series", ts: str = "day") -> DataFrame:
    """Add vwap of the typical price over n rows and the close's z against its deviation."""
    w = by(series, ts)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("vwap", ratio(rolling(F.sum, typical * F.col("volume"), w, n), rolling(F.sum, F.col("volume"), w, n)))
    df = df.withColumn("_dev", F.col("close") - F.col("vwap"))
    return df.withColumn("vwap_z", ratio(F.col("_dev"), rolling(F.stddev_samp, F.col("_dev"), w, n))).drop("_dev")


def ou_fit(df: DataFrame, value: str, series: list[str]) -> DataFrame:
    """half_life and sigma_eq of each series from the regression of changes on levels; df has (series, ts, value)."""
    w = Window.partitionBy(*series).orderBy("ts")
    x = F.lag(value).over(w)
    d = df.withColumns({"_x": x, "_d": F.col(value) - x}).filter(F.col("_x").isNotNull() & F.col("_d").isNotNull())
    g = d.groupBy(*series).agg(F.count("*").alias("n"), F.regr_slope("_d", "_x").alias("b"), F.regr_sxx("_d", "_x").alias("sxx"), F.regr_syy("_d", "_x").alias("syy"))
    phi = 1 + F.col("b")
    residual = (F.col("syy") - F.col("b") ** 2 * F.col("sxx")) / F.col("n")
    return g.select(
        *series, "n",
        F.when((F.col("n") >= 3) & (F.col("b") >= 0), F.lit(float("inf"))).when(F.col("n") >= 3, -F.lit(LN2) / F.col("b")).alias("half_life"),
        F.when((F.col("n") >= 3) & (F.abs(phi) < 1), F.sqrt(residual / (1 - phi**2))).alias("sigma_eq"),
    )


def hurst_value(x: list[float], max_lag: int = 20) -> float | None:
    """Slope of log root-mean-square differences on log lags, lags below min(max_lag, n // 2); NULL under 20 values or three lags."""
    import numpy as np

    a = np.asarray([v for v in x if v is not None and v == v], float)
    if len(a) < 20:
        return None
    points = [(k, math.sqrt(float(np.mean((a[k:] - a[:-k]) ** 2)))) for k in range(2, min(max_lag, len(a) // 2))]
    points = [(math.log(k), math.log(s)) for k, s in points if s > 0]
    return float(np.polyfit(*zip(*points), 1)[0]) if len(points) >= 3 else None


def hurst(df: DataFrame, value: str = "close", n: int | None = None, series: str = "series", ts: str = "day", max_lag: int = 20) -> DataFrame:
    """Add hurst of the last n rows, or (n None) one row for each series."""

    @F.pandas_udf(T.DoubleType())
    def est(lists):
        return lists.map(lambda x: None if x is None else hurst_value(list(x), max_lag))

    if n is None:
        return df.groupBy(series).agg(F.array_sort(F.collect_list(F.struct(ts, value))).alias("_s")).select(series, est(F.transform("_s", lambda s: s[value])).alias("hurst"))
    w = by(series, ts)
    listed = F.when(F.count(value).over(w.rowsBetween(-(n - 1), 0)) == n, F.collect_list(value).over(w.rowsBetween(-(n - 1), 0)))
    return df.withColumn("_l", listed).withColumn("hurst", est("_l")).drop("_l")


def variance_ratio(df: DataFrame, q: int = 2, r: str = "ret", series: str = "series", ts: str = "day") -> DataFrame:
    """vr, z (robust) and p of each series' returns."""
    from tidemark.functions.scalars import erfc

    w = by(series, ts)
    d = df.filter(F.col(r).isNotNull())
    mean = d.groupBy(series).agg(F.avg(r).alias("mu"), F.count("*").alias("n"))
    d = d.join(mean, series).withColumn("e", F.col(r) - F.col("mu"))
    d = d.withColumn("qs", F.when(F.count("e").over(w.rowsBetween(-(q - 1), 0)) == q, F.sum("e").over(w.rowsBetween(-(q - 1), 0))))
    for k in range(1, q):
        d = d.withColumn(f"c{k}", F.col("e") ** 2 * F.lag(F.col("e") ** 2, k).over(w))
    g = d.groupBy(series).agg(F.max("n").alias("n"), F.sum(F.col("e") ** 2).alias("ss"), F.sum(F.col("qs") ** 2).alias("qq"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(1, q)])
    m = q * (F.col("n") - q + 1) * (1 - q / F.col("n"))
    vr = ratio(F.col("qq") / m, F.col("ss") / (F.col("n") - 1))
    theta = sum((F.lit((2 * (q - k) / q) ** 2) * ratio(F.col("n") * F.col(f"c{k}"), F.col("ss") ** 2) for k in range(1, q)), F.lit(0.0))
    z = ratio(F.sqrt(F.col("n")) * (vr - 1), F.sqrt(theta))
    return g.select(series, "n", vr.alias("vr"), z.alias("z")).withColumn("p", erfc(F.abs("z") / math.sqrt(2)))
