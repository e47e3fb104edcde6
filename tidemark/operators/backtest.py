"""Backtests without look-ahead: costs on turnover, walk-forward and combinatorial folds, statistics, ledgers."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import prior, ratio


def run(df: DataFrame, cost_bps: float = 10.0, slippage_bps: float = 2.0, keys: tuple[str, ...] = ("series",), ts: str = "day", ret: Column | None = None) -> DataFrame:
    """Add traded (the position of the row before), turnover, gross, net and equity. df has position and close (or give ret)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    r = ratio(F.col("close"), F.lag("close").over(w)) - 1 if ret is None else ret
    df = df.withColumns({"ret": r, "traded": F.coalesce(F.lag("position").over(w), F.lit(0.0))})
    df = df.withColumn("turnover", F.abs(F.col("traded") - F.coalesce(F.lag("traded").over(w), F.lit(0.0))))
    df = df.withColumn("gross", F.col("traded") * F.coalesce("ret", F.lit(0.0)))
    df = df.withColumn("net", F.col("gross") - F.col("turnover") * (cost_bps + slippage_bps) / 10_000)
    growth = F.sum(F.when(F.col("net") > -1, F.log1p("net"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ruined = F.max((F.col("net") <= -1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return df.withColumn("equity", F.when(ruined, 0.0).otherwise(F.exp(growth)))


def run_funding(df: DataFrame, cost_bps: float = 10.0, slippage_bps: float = 2.0, keys: tuple[str, ...] = ("series",), ts: str = "day") -> DataFrame:
    """As run(), but a position earns minus the funding rate."""
    return run(df, cost_bps, slippage_bps, keys, ts, ret=-F.col("rate"))


def look_ahead(traded: DataFrame, keys: tuple[str, ...] = ("series",), ts: str = "day") -> DataFrame:
    """Rows whose traded position is not the position of the row before: empty for an honest backtest."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return traded.withColumn("_want", F.coalesce(F.lag("position").over(w), F.lit(0.0))).filter(~F.col("traded").eqNullSafe(F.col("_want"))).drop("_want")


def stats(returns: DataFrame, keys: list[str], r: str = "net", ts: str = "day", year: float = 365) -> DataFrame:
    """n, mean, sharpe, sortino, vol, cagr, max_drawdown, calmar, hit_rate, var5, cvar5, skew, kurt of the returns of each key."""
    x = F.col(r)
    d = returns.filter(x.isNotNull() & ~F.isnan(x))
    w = Window.partitionBy(*keys).orderBy(ts)
    d = d.withColumn("_g", F.sum(F.when(x > -1, F.log1p(x))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_dd", F.exp(F.col("_g") - F.greatest(F.max("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))) - 1)
    q = d.groupBy(*keys).agg(F.percentile(r, F.lit(0.05)).alias("var5"))
    d = d.join(q, keys)
    n = F.count("*")
    sd = F.stddev_samp(r)
    g = d.groupBy(*keys).agg(
        n.alias("n"), F.avg(r).alias("mean"), sd.alias("_sd"), F.sqrt(F.avg(F.least(x, F.lit(0.0)) ** 2)).alias("_down"), F.max_by("_g", ts).alias("_growth"), F.max((x <= -1).cast("int")).alias("_ruin"),
        F.min("_dd").alias("max_drawdown"), ratio(F.count(F.when(x > 0, 1)), F.count(F.when(x != 0, 1))).alias("hit_rate"), F.first("var5").alias("var5"), F.avg(F.when(x <= F.col("var5"), x)).alias("cvar5"),
        F.skewness(r).alias("_g1"), F.kurtosis(r).alias("_g2"),
    )
    m = F.col("n")
    cagr = F.when(F.col("_ruin") == 1, -1.0).otherwise(F.exp(F.col("_growth") * year / m) - 1)
    return g.select(
        *keys, "n", "mean", (ratio(F.col("mean"), F.col("_sd")) * math.sqrt(year)).alias("sharpe"), (ratio(F.col("mean"), F.col("_down")) * math.sqrt(year)).alias("sortino"), (F.col("_sd") * math.sqrt(year)).alias("vol"),
        cagr.alias("cagr"), "max_drawdown", ratio(cagr, F.abs("max_drawdown")).alias("calmar"), "hit_rate", "var5", "cvar5",
        F.when(m > 2, F.col("_g1") * F.sqrt(m * (m - 1)) / (m - 2)).alias("skew"), F.when(m > 3, ((m + 1) * F.col("_g2") + 6) * (m - 1) / ((m - 2) * (m - 3)) + 3).alias("kurt"),
    )


def anchored_blocks(df: DataFrame, n_splits: int, keys: list[str], ts: str = "day") -> DataFrame:
    """Add block: n_splits + 1 blocks of whole rows whose edges are evenly spaced and cut down; block 0 only trains."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(ts)) - 1, F.count("*").over(w)
    df = df.withColumns({"_i": i, "_n": n})
    edges = [F.floor(F.col("_n") * k / (n_splits + 1)) for k in range(1, n_splits + 1)]
    return df.withColumn("block", sum((F.when(F.col("_i") >= e, 1).otherwise(0) for e in edges), F.lit(0))).drop("_i", "_n")


def walk_forward(df: DataFrame, n_splits: int = 5, keys: list[str] | None = None, cost_bps: float = 10.0, slippage_bps: float = 2.0) -> DataFrame:
    """Out-of-sample returns of a rule whose positions need no fitting: rows of blocks 1.., with their fold."""
    keys = keys or ["series"]
    return anchored_blocks(run(df, cost_bps, slippage_bps, tuple(keys)), n_splits, keys).filter("block > 0").withColumnRenamed("block", "fold")


def cpcv(returns: DataFrame, n_blocks: int = 6, k_test: int = 2, embargo: int = 0, r: str = "net", ts: str = "day", keys: list[str] | None = None, year: float = 365) -> DataFrame:
    """Sharpe ratio of every choice of k_test blocks, the first `embargo` rows of a block that follows a training block left out."""
    keys = keys or ["series"]
    spark = returns.sparkSession
    d = anchored_blocks(returns.filter(F.col(r).isNotNull()), n_blocks - 1, keys, ts)
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(ts)))
    combos = [(i, b, b - 1 in c or b == 0) for i, c in enumerate(combinations(range(n_blocks), k_test)) for b in c]
    plan = spark.createDataFrame(combos, "combo int, block int, joined boolean")  # C(n_blocks, k_test) * k_test rows
    d = d.join(F.broadcast(plan), "block").filter(F.col("joined") | (F.col("_in") > embargo))
    return d.groupBy(*keys, "combo").agg(F.count("*").alias("n"), (ratio(F.avg(r), F.stddev_samp(r)) * math.sqrt(year)).alias("sharpe"))


def pbo(returns: DataFrame, n_blocks: int = 8, r: str = "net", strategy: str = "strategy", ts: str = "day") -> DataFrame:
    """Probability of backtest overfitting: over all halves of the blocks, how often the best inside (of equals the first name) beats less than half of all outside.

    Only block moments are shuffled; the halves are joined to those.
    """
    spark = returns.sparkSession
    d = anchored_blocks(returns, n_blocks - 1, [strategy], ts)
    m = d.groupBy(strategy, "block").agg(F.count(r).alias("n"), F.sum(r).alias("s"), F.sum(F.col(r) ** 2).alias("ss"))
    halves = [(i, b, b in c) for i, c in enumerate(combinations(range(n_blocks), n_blocks // 2)) for b in range(n_blocks)]
    plan = spark.createDataFrame(halves, "combo int, block int, inside boolean")
    g = m.join(F.broadcast(plan), "block").groupBy("combo", strategy, "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    sr = ratio(mean, F.sqrt(F.greatest((F.col("ss") - F.col("n") * mean**2) / (F.col("n") - 1), F.lit(0.0))))
    g = g.select("combo", strategy, "inside", F.coalesce(F.round(sr, 12), F.lit(0.0)).alias("sr"))
    wide = g.groupBy("combo", strategy).agg(F.max(F.when(F.col("inside"), F.col("sr"))).alias("is_sr"), F.max(F.when(~F.col("inside"), F.col("sr"))).alias("oos_sr"))
    beaten = (F.rank().over(Window.partitionBy("combo").orderBy("oos_sr")) - 1) / F.count("*").over(Window.partitionBy("combo"))
    best = wide.withColumn("_r", beaten).groupBy("combo").agg(F.min_by("_r", F.struct(-F.col("is_sr"), F.col(strategy))).alias("rank"))
    return best.agg(F.count("*").alias("combos"), F.avg((F.col("rank") < 0.5).cast("double")).alias("pbo"))


def trade_ledger(traded: DataFrame, keys: tuple[str, ...] = ("series",), ts: str = "day", k: float = 2.0, n: int = 20) -> DataFrame:
    """One row for each run of one sign of the traded position: times, return, worst return on the way, risk (the entry's weight times k daily deviations then), and return and worst return in units of it."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = traded.withColumn("_sd", prior(F.stddev_samp, F.col("ret"), w, n))
    sign = F.signum("traded")
    d = d.withColumn("_s", sign).withColumn("_new", F.when(F.col("_s").eqNullSafe(F.lag("_s").over(w)), 0).otherwise(1))
    d = d.withColumn("trade", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_s <> 0")
    path = F.sum(F.log1p("gross")).over(Window.partitionBy(*keys, "trade").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_p", F.exp(path) - 1)
    g = d.groupBy(*keys, "trade").agg(F.min(ts).alias("entry"), F.max(ts).alias("exit"), F.count("*").alias("bars"), F.first("_s").alias("side"), F.max_by("_p", ts).alias("ret"), F.min("_p").alias("mae"), (F.abs(F.min_by("traded", ts)) * k * F.min_by("_sd", ts)).alias("risk"))
    return g.withColumns({"r": ratio(F.col("ret"), F.col("risk")), "mae_r": ratio(F.col("mae"), F.col("risk"))})


def expectancy(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Trades, win rate, mean R, payoff, SQN, profit factor, longest run of losses and mean adverse excursion."""
    r = F.col("r")
    d = ledger.filter("r is not null")
    w = Window.partitionBy(*keys).orderBy("trade")
    d = d.withColumn("_g", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, r > 0).orderBy("trade")))
    streak = d.filter("r <= 0").groupBy(*keys, "_g").count().groupBy(*keys).agg(F.max("count").alias("loss_streak"))
    g = d.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg("r").alias("expectancy"), ratio(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r <= 0, r)))).alias("payoff"),
        (ratio(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.count("*"))).alias("sqn"), ratio(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r <= 0, r)))).alias("profit_factor"), F.avg("mae_r").alias("mae_r"),
    )
    return g.join(streak, keys, "left").withColumn("loss_streak", F.coalesce("loss_streak", F.lit(0)))


class LockBox:
    """Lets a final sample be evaluated once."""

    def __init__(self):
        self.used: set[str] = set()

    def evaluate(self, name: str, fn):
        if name in self.used:
            raise RuntimeError(f"{name} was evaluated before")
        self.used.add(name)
        return fn()


def bootstrap_index(length: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """Stationary bootstrap: blocks of geometric length that wrap round."""
    fresh = rng.random(length) < 1 / mean_block
    fresh[0] = True
    start = rng.integers(0, length, length)
    at = np.maximum.accumulate(np.where(fresh, np.arange(length), 0))
    return (start[at] + np.arange(length) - at) % length


def null_pbos(spark: SparkSession, returns: np.ndarray, replicates: int, n_blocks: int = 8, mean_block: float | None = 10.0, seed: int = 0) -> DataFrame:
    """replicate, pbo under a null: columns resampled each on its own (or Gaussian, mean_block None). Replicates run side by side."""
    send = spark.sparkContext.broadcast(returns)

    def one(rep: int) -> float:
        rng, m = np.random.default_rng([seed, rep]), send.value
        t, n = m.shape
        x = np.column_stack([(m[:, j] - m[:, j].mean())[bootstrap_index(t, mean_block, rng)] for j in range(n)]) if mean_block else rng.normal(0, m.std(0, ddof=1), (t, n))
        blocks = np.array_split(np.arange(t), n_blocks)
        low = []
        for c in combinations(range(n_blocks), n_blocks // 2):
            a, b = (x[np.concatenate([blocks[i] for i in range(n_blocks) if (i in c) == s])] for s in (True, False))
            sa, sb = (y.mean(0) / y.std(0, ddof=1) for y in (a, b))
            low.append(((sb < sb[sa.argmax()]).sum() + 1) / (n + 1) < 0.5)
        return float(np.mean(low))

    def run_all(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"replicate": b["id"], "pbo": [one(int(i)) for i in b["id"]]})

    return spark.range(replicates).mapInPandas(run_all, "replicate long, pbo double")


def pbo_verdict(observed: float, nulls: DataFrame) -> DataFrame:
    """Where the observed value lies among the null's 5th and 95th percentiles."""
    q = nulls.agg(F.percentile("pbo", F.lit(0.05)).alias("p5"), F.percentile("pbo", F.lit(0.95)).alias("p95"))
    return q.withColumn("verdict", F.when(F.lit(observed) < F.col("p5"), "below the null").when(F.lit(observed) > F.col("p95"), "above the null").otherwise("inside the null"))
