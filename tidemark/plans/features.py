"""Queries of rolling features over daily bars."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.windows import average_rank, by
from tidemark.operators import features as ft
from tidemark.plans.registry import query, rounded, sql_rounded
from tidemark.sources.schemas import daily, daily_sql

D = daily_sql(True)
W = "WINDOW w AS (PARTITION BY series ORDER BY day)"
ROLL = lambda n: f"(PARTITION BY series ORDER BY day ROWS {n - 1} PRECEDING)"
FULL = lambda agg, x, n: f"CASE WHEN count({x}) OVER {ROLL(n)} = {n} THEN {agg}({x}) OVER {ROLL(n)} END"


def _prices(spark, d):
    return daily(spark, d, by_priority=True)


@query("daily_bars", f"WITH {D} SELECT * FROM daily")
def daily_bars(spark, d):
    return _prices(spark, d)


RETURNS = f"""r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, ln(close / lag(close) OVER w) AS log_ret, close / lag(close, 20) OVER w - 1 AS mom, close / max(close) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM daily {W})"""


@query("return_features", f"""WITH {D}, {RETURNS}, f AS (SELECT series, day, ret, log_ret, mom, dd, {FULL('avg', 'close', 20)} AS mean, (close - {FULL('avg', 'close', 20)}) / ({FULL('stddev_samp', 'close', 20)}) AS z,
    {FULL('stddev_samp', 'log_ret', 20)} * sqrt(365) AS vol, ({FULL('avg', 'ret', 20)}) / ({FULL('stddev_samp', 'ret', 20)}) * sqrt(365) AS sharpe FROM r)
SELECT series, day, {sql_rounded('ret log_ret mom dd z vol sharpe')}, {sql_rounded('mean', 3)} FROM f""")
def return_features(spark, d):
    out = ft.return_features(_prices(spark, d), n=20).select("series", "day", "ret", "log_ret", "mom", "dd", "mean", "z", "vol", "sharpe")
    return rounded(rounded(out, "ret log_ret mom dd z vol sharpe"), "mean", 3)


@query("max_drawdown", f"WITH {D}, {RETURNS} SELECT series, round(min(dd), 6) + 0.0 AS max_drawdown FROM r GROUP BY 1")
def max_drawdown(spark, d):
    p = _prices(spark, d).withColumn("dd", ft.drawdown(F.col("close"), by("series", "day")))
    return rounded(p.groupBy("series").agg(F.min("dd").alias("max_drawdown")), "max_drawdown")


def ewm_sql(x: str, alpha: float, least: int, where: str = "daily") -> str:
    """The exponential mean as a fold over the rows so far."""
    fold = f"list_reduce(list({x}) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING), lambda a, b: {1 - alpha!r} * a + {alpha!r} * b)"
    return f"CASE WHEN count({x}) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING) >= {least} THEN {fold} END"


TR = f"tr AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM daily {W})"


@query("ema", f"WITH {D}, e AS (SELECT series, day, {ewm_sql('close', 2 / 11, 10)} AS ema FROM daily) SELECT series, day, {sql_rounded('ema', 3)} FROM e")
def ema(spark, d):
    return rounded(ft.ema(_prices(spark, d), "close", 10).select("series", "day", "ema"), "ema", 3)


@query("atr", f"WITH {D}, {TR}, a AS (SELECT series, day, tr, {ewm_sql('tr', 1 / 14, 14)} AS atr FROM tr) SELECT series, day, {sql_rounded('tr atr', 4)} FROM a")
def atr(spark, d):
    return rounded(ft.atr(_prices(spark, d)).select("series", "day", "tr", "atr"), "tr atr", 4)


@query("rsi", f"""WITH {D}, ch AS (SELECT series, day, greatest(c, 0) AS up, greatest(-c, 0) AS down FROM (SELECT series, day, close - lag(close) OVER w AS c FROM daily {W}) WHERE c IS NOT NULL),
x AS (SELECT series, day, {ewm_sql('up', 1 / 14, 14)} AS u, {ewm_sql('down', 1 / 14, 14)} AS dn FROM ch)
SELECT d.series, d.day, round(CASE WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + u / dn) END, 5) + 0.0 AS rsi FROM daily d LEFT JOIN x ON d.series = x.series AND d.day = x.day""")
def rsi(spark, d):
    return rounded(ft.rsi(_prices(spark, d)).select("series", "day", "rsi"), "rsi", 5)


@query("adx")
def adx(spark, d):
    return rounded(ft.adx(_prices(spark, d)).select("series", "day", "adx"), "adx", 5)


@query("yang_zhang", f"""WITH {D}, x AS (SELECT series, day, ln(open / lag(close) OVER w) AS o, ln(close / open) AS c, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM daily {W}),
y AS (SELECT series, day, {FULL('var_samp', 'o', 20)} AS vo, {FULL('var_samp', 'c', 20)} AS vc, {FULL('avg', 'rs', 20)} AS vr FROM x)
SELECT series, day, round(sqrt(CASE WHEN vo IS NOT NULL AND vc IS NOT NULL AND vr IS NOT NULL THEN greatest(vo + k * vc + (1 - k) * vr, 0) END * 365), 6) + 0.0 AS yz FROM (SELECT *, 0.34 / (1.34 + 21.0 / 19.0)::DOUBLE AS k FROM y)""")
def yang_zhang(spark, d):
    return rounded(ft.yang_zhang(_prices(spark, d)).select("series", "day", "yz"), "yz")


PRIOR = lambda agg, x, n: f"CASE WHEN count({x}) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {agg}({x}) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"


@query("donchian_channels", f"WITH {D} SELECT series, day, {PRIOR('max', 'high', 55)} AS hi, {PRIOR('min', 'low', 55)} AS lo, {PRIOR('max', 'high', 20)} AS exit_hi, {PRIOR('min', 'low', 20)} AS exit_lo FROM daily")
def donchian_channels(spark, d):
    return ft.donchian(_prices(spark, d)).select("series", "day", "hi", "lo", "exit_hi", "exit_lo")


@query("vwap_bands", f"""WITH {D}, v AS (SELECT series, day, close, {FULL('sum', '(high + low + close) / 3 * volume', 48)} AS pv, {FULL('sum', 'volume', 48)} AS q FROM daily), x AS (SELECT series, day, pv / q AS vwap, close - pv / q AS dev FROM v),
y AS (SELECT series, day, vwap, dev / ({FULL('stddev_samp', 'dev', 48)}) AS vwap_z FROM x) SELECT series, day, {sql_rounded('vwap', 3)}, {sql_rounded('vwap_z')} FROM y""")
def vwap_bands(spark, d):
    out = ft.vwap_bands(_prices(spark, d)).select("series", "day", "vwap", "vwap_z")
    return rounded(rounded(out, "vwap", 3), "vwap_z")


PAIR = f"{D}, a AS (SELECT day, close AS x FROM daily WHERE series = '1-URGENT'), b AS (SELECT day, close AS y FROM daily WHERE series = '5-LOW'), pr AS (SELECT day, x, y, x / lag(x) OVER (ORDER BY day) - 1 AS rx, y / lag(y) OVER (ORDER BY day) - 1 AS ry FROM a JOIN b USING (day))"


def pair(spark, d):
    p = _prices(spark, d)
    one, two = (p.filter(F.col("series") == s).select("day", F.col("close").alias(c)) for s, c in (("1-URGENT", "x"), ("5-LOW", "y")))
    j = one.join(two, "day").withColumn("series", F.lit("PAIR"))
    w = by("series", "day")
    return j.withColumns({"rx": ft.simple_returns(F.col("x"), w), "ry": ft.simple_returns(F.col("y"), w)})


@query("rolling_corr", f"WITH {PAIR} SELECT day, round(CASE WHEN count(rx) OVER w >= 15 THEN corr(rx, ry) OVER w END, 6) + 0.0 AS r FROM pr WINDOW w AS (ORDER BY day ROWS 29 PRECEDING)")
def rolling_corr(spark, d):
    w = by("series", "day")
    return rounded(pair(spark, d).select("day", ft.rolling_corr(F.col("rx"), F.col("ry"), w, 30).alias("r")), "r")


@query("hedge_beta", f"WITH {PAIR} SELECT day, round(CASE WHEN count(rx) OVER w = 30 THEN covar_samp(rx, ry) OVER w / var_samp(ry) OVER w END, 6) + 0.0 AS beta FROM pr WINDOW w AS (ORDER BY day ROWS 29 PRECEDING)")
def hedge_beta(spark, d):
    frame = by("series", "day").rowsBetween(-29, 0)
    beta = F.when(F.count("rx").over(frame) == 30, F.try_divide(F.covar_samp("rx", "ry").over(frame), F.var_samp("ry").over(frame)))
    return rounded(pair(spark, d).select("day", beta.alias("beta")), "beta")


@query("variance_risk_premium", f"""WITH {D}, {RETURNS}, v AS (SELECT series, day, {FULL('stddev_samp', 'log_ret', 20)} * sqrt(365) AS vol FROM r)
SELECT a.day, round(a.vol - b.vol, 6) + 0.0 AS vrp FROM v a JOIN v b ON a.day = b.day AND a.series = '1-URGENT' AND b.series = '5-LOW'""")
def variance_risk_premium(spark, d):
    v = ft.return_features(_prices(spark, d), n=20)
    a, b = (v.filter(F.col("series") == s).select("day", F.col("vol").alias(c)) for s, c in (("1-URGENT", "iv"), ("5-LOW", "rv")))
    return rounded(a.join(b, "day").select("day", (F.col("iv") - F.col("rv")).alias("vrp")), "vrp")


@query("ou_fit", f"""WITH {D}, x AS (SELECT series, ln(close) AS v, lag(ln(close)) OVER w AS x FROM daily {W}), g AS (SELECT series, count(*) AS n, regr_slope(v - x, x) AS b, regr_sxx(v - x, x) AS sxx, regr_syy(v - x, x) AS syy FROM x WHERE x IS NOT NULL GROUP BY 1)
SELECT series, n, round(CASE WHEN b < 0 THEN -ln(2) / b END, 6) + 0.0 AS half_life, round(CASE WHEN abs(1 + b) < 1 THEN sqrt((syy - b * b * sxx) / n / (1 - (1 + b) * (1 + b))) END, 6) + 0.0 AS sigma_eq FROM g""")
def ou_fit(spark, d):
    p = _prices(spark, d).select("series", F.col("day").alias("ts"), F.log("close").alias("v"))
    return rounded(ft.ou_fit(p, "v", ["series"]), "half_life sigma_eq")


@query("hurst")
def hurst(spark, d):
    return rounded(ft.hurst(_prices(spark, d).withColumn("close", F.log("close"))), "hurst")


@query("hurst_rolling")
def hurst_rolling(spark, d):
    return rounded(ft.hurst(_prices(spark, d).withColumn("close", F.log("close")), n=100).select("series", "day", "hurst"), "hurst")


@query("variance_ratio", f"""WITH {D}, {RETURNS}, e AS (SELECT series, day, ret - avg(ret) OVER (PARTITION BY series) AS e FROM r WHERE ret IS NOT NULL),
s AS (SELECT *, CASE WHEN count(*) OVER w = 2 THEN sum(e) OVER w END AS qs, e * e * power(lag(e) OVER (PARTITION BY series ORDER BY day), 2) AS c FROM e WINDOW w AS (PARTITION BY series ORDER BY day ROWS 1 PRECEDING)),
g AS (SELECT series, count(*) AS n, sum(e * e) AS ss, sum(qs * qs) AS qq, sum(c) AS c FROM s GROUP BY 1)
SELECT series, n, round(vr, 6) + 0.0 AS vr, round(sqrt(n) * (vr - 1) / sqrt(n * c / (ss * ss)), 6) + 0.0 AS z FROM (SELECT *, qq / (2 * (n - 1) * (1 - 2.0 / n)) / (ss / (n - 1)) AS vr FROM g)""")
def variance_ratio(spark, d):
    p = ft.return_features(_prices(spark, d))
    return rounded(ft.variance_ratio(p, 2).select("series", "n", "vr", "z"), "vr z")


@query("average_rank", f"WITH {D} SELECT series, day, rank() OVER (PARTITION BY series ORDER BY volume) + (count(*) OVER (PARTITION BY series, volume) - 1) / 2.0::DOUBLE AS r FROM daily")
def avg_rank(spark, d):
    return _prices(spark, d).select("series", "day", average_rank(F.col("volume"), ["series"]).alias("r"))
