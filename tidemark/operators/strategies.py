"""Trading rules: desired position by row, NULL in the warm-up; they are traded one bar later.

Rules without memory are window expressions. Rules whose position depends on the position before are
ordered folds: one series at a time in applyInPandas, so a series must fit one task (a daily series
does; series run side by side).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import by, ratio, rolling
from tidemark.operators import features as ft


def fold(df: DataFrame, columns: list[str], machine: Callable[[np.ndarray], np.ndarray], name: str = "position", series: str = "series", ts: str = "day") -> DataFrame:
    """(series, ts, name): machine gets the columns of one series in time order as a float matrix."""
    types = dict(df.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(ts)
        return pd.DataFrame({series: g[series], ts: g[ts], name: machine(g[columns].to_numpy(float))})

    return df.select(series, ts, *columns).groupBy(series).applyInPandas(run, f"{series} {types[series]}, {ts} {types[ts]}, {name} double")


def one_step(step: Callable[[float, np.ndarray], float], known: Callable[[np.ndarray], bool] = lambda row: row[0] == row[0]):
    """A machine that takes one step a row, from the state 0: out of a position and into the next one are two rows. Rows that are not known keep the state."""

    def machine(x: np.ndarray) -> np.ndarray:
        state, out = 0.0, np.empty(len(x))
        for i, row in enumerate(x):
            if known(row):
                state = step(state, row)
            out[i] = state
        return out

    return machine


def fade(entry: float, leave: float):
    """Against a score: in beyond entry, out within leave; with a second column, flat where that is 0."""

    def step(state: float, row: np.ndarray) -> float:
        z, open_ = row[0], len(row) < 2 or row[1]
        if not open_:
            return 0.0
        if not state:
            return -1.0 if z > entry else 1.0 if z < -entry else 0.0
        return 0.0 if abs(z) < leave else state

    return one_step(step)


def buy_and_hold() -> Column:
    return F.lit(1.0)


def ma_trend_filter(df: DataFrame, n: int = 200, fast: int | None = None, series: str = "series", ts: str = "day") -> DataFrame:
    """1 where the close (or its fast mean) is above its slow mean."""
    if fast is not None and fast >= n:
        raise ValueError("fast must be below n")
    w = by(series, ts)
    slow, lead = ft.sma(F.col("close"), w, n), F.col("close") if fast is None else ft.sma(F.col("close"), w, fast)
    return df.withColumn("position", F.when(slow.isNotNull() & lead.isNotNull(), (lead > slow).cast("double")))


def vol_target(df: DataFrame, target: float = 0.15, n: int = 20, year: float = 365, most: float = 3.0, series: str = "series", ts: str = "day") -> DataFrame:
    """Scale position by target volatility over realized, at most `most`, the product inside [-1, 1]."""
    w = by(series, ts)
    df = df.withColumn("_r", ft.log_returns(F.col("close"), w))
    df = df.withColumn("_s", ft.realized_vol(F.col("_r"), w, n, year))
    scaled = F.col("position") * F.least(ratio(F.lit(target), F.col("_s")), F.lit(most))
    return df.withColumn("position", F.when(F.col("_s").isNotNull() & F.col("position").isNotNull(), F.greatest(F.least(scaled, F.lit(1.0)), F.lit(-1.0)))).drop("_r", "_s")


def tsmom(df: DataFrame, lookback: int = 20, scaled: bool = True, long_short: bool = False, series: str = "series", ts: str = "day", **kw) -> DataFrame:
    """Sign of the momentum, long or flat unless long_short, scaled to a target volatility."""
    m = ft.momentum(F.col("close"), by(series, ts), lookback)
    df = df.withColumn("position", F.signum(m) if long_short else F.when(m.isNotNull(), (m > 0).cast("double")))
    return vol_target(df, series=series, ts=ts, **kw) if scaled else df


def percent_risk_size(df: DataFrame, risk: float = 0.02, n: int = 20, k: float = 2.0, most: float = 3.0) -> DataFrame:
    """Scale position so that k average true ranges lose `risk`."""
    a = ft.atr(df, n)
    size = F.least(ratio(F.lit(risk), k * ratio(F.col("atr"), F.col("close"))), F.lit(most))
    return a.withColumn("position", F.greatest(F.least(F.col("position") * size, F.lit(1.0)), F.lit(-1.0))).drop("tr", "atr")


def donchian_breakout(df: DataFrame, n: int = 55, exit_n: int = 20) -> DataFrame:
    """Long above the entry channel, short below it, flat again through the opposite exit channel; flat in the warm-up."""

    def step(state: float, row: np.ndarray) -> float:
        close, hi, lo, exit_hi, exit_lo = row
        if not state:
            return 1.0 if close > hi else -1.0 if close < lo else 0.0
        return 0.0 if (close < exit_lo if state > 0 else close > exit_hi) else state

    return fold(ft.donchian(df, n, exit_n), ["close", "hi", "lo", "exit_hi", "exit_lo"], one_step(step, lambda row: row[1] == row[1] and row[2] == row[2]))


def vwap_reversion(df: DataFrame, n: int = 48, k: float = 2.0, exit_k: float = 0.5) -> DataFrame:
    """Against the deviation from vwap: in beyond k, out within exit_k; an unknown deviation holds."""
    return fold(ft.vwap_bands(df, n), ["vwap_z"], fade(k, exit_k))


def regime_gate(df: DataFrame, hurst_n: int = 200, hurst_max: float = 0.45, adx_n: int = 14, adx_max: float = 22.0) -> DataFrame:
    """Add gate: rolling Hurst and adx both low; unknown is closed."""
    g = ft.adx(ft.hurst(df.withColumn("_c", F.log("close")), "_c", hurst_n), adx_n)
    return g.withColumn("gate", F.coalesce((F.col("hurst") < hurst_max) & (F.col("adx") < adx_max), F.lit(False))).drop("_c")


def mean_reversion(df: DataFrame, n: int = 20, entry: float = 2.0, leave: float = 0.5, gated: bool = False, **gate) -> DataFrame:
    """Against the z-score; with the gate closed, flat; an unknown score holds."""
    z = df.withColumn("z", ft.zscore(F.col("close"), by("series", "day"), n))
    z = regime_gate(z, **gate).withColumn("gate", F.col("gate").cast("double")) if gated else z.withColumn("gate", F.lit(1.0))
    return fold(z, ["z", "gate"], fade(entry, leave))


def random_entry(df: DataFrame, seed: int = 0, k: float = 3.0, n: int = 10) -> DataFrame:
    """Coin-flip entries with a trailing stop of k average true ranges; seeded for each series alike."""

    def machine(x: np.ndarray) -> np.ndarray:
        rng, state, stop, out = np.random.default_rng(seed), 0.0, 0.0, np.full(len(x), np.nan)
        for i, (close, a) in enumerate(x):
            if a != a:
                continue
            if state:
                stop = max(stop, close - k * a) if state > 0 else min(stop, close + k * a)
                if (close - stop) * state <= 0:
                    state = 0.0
            if not state:
                state = 1.0 if rng.random() < 0.5 else -1.0
                stop = close - state * k * a
            out[i] = state
        return out

    return fold(ft.atr(df, n), ["close", "atr"], machine)


def fixed_r_exit(df: DataFrame, k: float = 2.0, rr: float = 3.0, n: int = 20) -> DataFrame:
    """Overlay on position, of which only the sign counts: in where the range is known, out at k average true ranges against, rr times that in favour (the stop is looked at first), or where the sign goes; in again on a later row while it holds."""

    def machine(x: np.ndarray) -> np.ndarray:
        held, stop, goal, out = 0.0, 0.0, 0.0, np.zeros(len(x))
        for i, (wish, close, high, low, a) in enumerate(x):
            wish = float(np.sign(np.nan_to_num(wish)))
            if held:
                worst, best = (low, high) if held > 0 else (high, low)
                if (worst - stop) * held <= 0 or (best - goal) * held >= 0 or wish != held:
                    held = 0.0
            elif wish and np.isfinite(a):
                held, stop, goal = wish, close - wish * k * a, close + wish * rr * k * a
            out[i] = held
        return out

    return fold(ft.atr(df, n), ["position", "close", "high", "low", "atr"], machine)


def carry(df: DataFrame, enter: float = 0.1, leave: float = 0.055, smooth: int = 3, per_year: int = 1095, inversion: bool = True) -> DataFrame:
    """Short the perpetual while its exponentially smoothed funding a year is high (long while it is as far below zero, if inversion). df has rate; NULL in the warm-up."""
    if leave > enter:
        raise ValueError("leave must not be above enter")

    def step(state: float, row: np.ndarray) -> float:
        a = row[0]
        if not state:
            return -1.0 if a > enter else 1.0 if inversion and a < -enter else 0.0
        return 0.0 if (a < leave if state < 0 else a > -leave) else state

    def machine(x: np.ndarray) -> np.ndarray:
        apr = pd.Series(x[:, 0]).ewm(span=max(1, smooth), adjust=False, min_periods=max(1, smooth)).mean().to_numpy() * per_year
        return np.where(np.isnan(apr), np.nan, one_step(step)(apr[:, None]))

    return fold(df, ["rate"], machine)


def _ar1(x: np.ndarray) -> tuple[float, float]:
    """Half-life and equilibrium deviation of a window."""
    d, lag = np.diff(x), x[:-1]
    sxx = ((lag - lag.mean()) ** 2).sum()
    if len(x) < 4 or sxx <= 0:
        return math.nan, math.nan
    b = ((lag - lag.mean()) * (d - d.mean())).sum() / sxx
    residual = d - d.mean() - b * (lag - lag.mean())
    phi = 1 + b
    return (math.log(2) / -b if b < 0 else math.inf), (math.sqrt((residual**2).mean() / (1 - phi**2)) if abs(phi) < 1 else math.nan)


def pairs(df: DataFrame, n: int = 60, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, most_half_life: float = 60.0, model: str = "coint") -> DataFrame:
    """position and beta of a pair (x, y by day): log spread with a rolling beta, its z-score (coint) or its deviation in equilibrium units (ou); entry, exit, stop, and flat while reversion is slower than most_half_life."""
    w = by("series", "day")
    lx, ly = F.log("x"), F.log("y")
    frame = w.rowsBetween(-(n - 1), 0)
    beta = F.when(F.count("_ly").over(frame) == n, F.try_divide(F.covar_samp("_lx", "_ly").over(frame), F.var_samp("_ly").over(frame)))
    d = df.withColumns({"_lx": lx, "_ly": ly}).withColumn("beta", beta).select("series", "day", "_lx", "_ly", "beta")
    types = dict(d.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("day")
        spread = (g["_lx"] - g["beta"] * g["_ly"]).to_numpy(float)
        state, out = 0.0, np.full(len(g), np.nan)
        for i in range(len(g)):
            own = spread[max(0, i - n + 1) : i + 1]
            if len(own) < n or np.isnan(own).any():
                continue
            half, sigma = _ar1(own)
            scale = own.std(ddof=1) if model == "coint" else sigma
            z = (own[-1] - own.mean()) / scale if scale and scale == scale else math.nan
            if z != z:
                continue
            if not half <= most_half_life:
                state = 0.0
            elif not state:
                state = -1.0 if z > entry else 1.0 if z < -entry else 0.0
            elif abs(z) < leave or abs(z) > stop:
                state = 0.0
            out[i] = state
        return pd.DataFrame({"series": g["series"], "day": g["day"], "position": out, "beta": g["beta"]})

    return d.groupBy("series").applyInPandas(run, f"series string, day {types['day']}, position double, beta double")


def short_vol(*_, **__):
    raise NotImplementedError("short volatility needs a priced option book")
