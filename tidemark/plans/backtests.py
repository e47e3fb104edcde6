"""Queries of strategies, backtests, risk and information coefficients over daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import by
from tidemark.operators import backtest as bt
from tidemark.operators import features as ft
from tidemark.operators import risk, strategies as st
from tidemark.plans.features import D, FULL, PRIOR, RETURNS, W, _prices, pair
from tidemark.plans.registry import query, rounded, sql_rounded


def _trend(spark, d):
    return st.ma_trend_filter(_prices(spark, d), 50)


TREND = f"tf AS (SELECT *, CASE WHEN ({FULL('avg', 'close', 50)}) IS NOT NULL THEN CAST(close > ({FULL('avg', 'close', 50)}) AS DOUBLE) END AS position FROM daily)"


@query("ma_trend_filter", f"WITH {D}, {TREND} SELECT series, day, position FROM tf")
def ma_trend_filter(spark, d):
    return _trend(spark, d).select("series", "day", "position")


@query("tsmom", f"""WITH {D}, {RETURNS}, v AS (SELECT series, day, CAST(mom > 0 AS DOUBLE) AS p, {FULL('stddev_samp', 'log_ret', 20)} * sqrt(365) AS s FROM r)
SELECT series, day, round(CASE WHEN s IS NOT NULL AND p IS NOT NULL THEN greatest(least(p * least(0.15 / s, 3.0), 1.0), -1.0) END, 6) + 0.0 AS position FROM v""")
def tsmom(spark, d):
    return rounded(st.tsmom(_prices(spark, d), 20).select("series", "day", "position"), "position")


def machine_sql(inputs: str, step: str, known: str) -> str:
    """A rule with memory as a recursive query: `inputs` gives series, day, i (from 1) and columns, `step` the next state from s.state and them; rows that are not known keep the state and are NULL."""
    return f"""{inputs}, st AS (SELECT DISTINCT series, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS state, CAST(NULL AS DOUBLE) AS position, CAST(NULL AS DATE) AS day FROM x
    UNION ALL SELECT x.series, x.i, CASE WHEN {known} THEN {step} ELSE s.state END, CASE WHEN {known} THEN {step} END, x.day FROM st s JOIN x ON x.series = s.series AND x.i = s.i + 1)
SELECT series, day, position FROM st WHERE i > 0"""


R = f"WITH RECURSIVE {D}"
NUMBERED = "row_number() OVER (PARTITION BY series ORDER BY day) AS i"
BREAKOUT = f"x AS (SELECT series, day, {NUMBERED}, close, {PRIOR('max', 'high', 20)} AS hi, {PRIOR('min', 'low', 20)} AS lo, {PRIOR('max', 'high', 10)} AS xhi, {PRIOR('min', 'low', 10)} AS xlo FROM daily)"
VWAP_Z = f"v AS (SELECT series, day, close, {FULL('sum', '(high + low + close) / 3 * volume', 20)} AS pv, {FULL('sum', 'volume', 20)} AS q FROM daily), dv AS (SELECT series, day, close - pv / q AS dev FROM v), x AS (SELECT series, day, {NUMBERED}, dev / ({FULL('stddev_samp', 'dev', 20)}) AS z FROM dv)"
CLOSE_Z = f"x AS (SELECT series, day, {NUMBERED}, (close - {FULL('avg', 'close', 20)}) / ({FULL('stddev_samp', 'close', 20)}) AS z FROM daily)"
FADE = "CASE WHEN x.z IS NULL THEN s.state WHEN s.state = 0 THEN CASE WHEN x.z > {enter} THEN -1.0 WHEN x.z < -{enter} THEN 1.0 ELSE 0.0 END WHEN abs(x.z) < {leave} THEN 0.0 ELSE s.state END"
CHANNEL = "CASE WHEN x.hi IS NULL THEN s.state WHEN s.state = 0 THEN CASE WHEN x.close > x.hi THEN 1.0 WHEN x.close < x.lo THEN -1.0 ELSE 0.0 END WHEN s.state > 0 AND x.close < x.xlo THEN 0.0 WHEN s.state < 0 AND x.close > x.xhi THEN 0.0 ELSE s.state END"
SMOOTH = f"""rt AS (SELECT series, day, {NUMBERED}, ln(close / open) / 1000 AS rate FROM daily), sm AS (SELECT series, i, day, rate AS e FROM rt WHERE i = 1 UNION ALL SELECT rt.series, rt.i, rt.day, 0.5 * sm.e + 0.5 * rt.rate FROM sm JOIN rt ON rt.series = sm.series AND rt.i = sm.i + 1),
x AS (SELECT series, day, i, CASE WHEN i >= 3 THEN e * 1095 END AS z FROM sm)"""
FUNDED = "CASE WHEN s.state = 0 THEN CASE WHEN x.z > 0.1 THEN -1.0 WHEN x.z < -0.1 THEN 1.0 ELSE 0.0 END WHEN s.state < 0 AND x.z < 0.055 THEN 0.0 WHEN s.state > 0 AND x.z > -0.055 THEN 0.0 ELSE s.state END"
MACHINES = {
    "donchian_breakout": f"{R}, {machine_sql(BREAKOUT, CHANNEL, 'true')}",
    "vwap_reversion": f"{R}, {machine_sql(VWAP_Z, FADE.format(leave=0.5, enter=2.0), 'true')}",
    "mean_reversion": f"{R}, {machine_sql(CLOSE_Z, FADE.format(leave=0.5, enter=1.5), 'true')}",
    "carry": f"{R}, {machine_sql(SMOOTH, FUNDED, 'x.z IS NOT NULL')}",
}

for _name, _rule in {
    "donchian_breakout": lambda p: st.donchian_breakout(p, 20, 10),
    "vwap_reversion": lambda p: st.vwap_reversion(p, 20),
    "mean_reversion": lambda p: st.mean_reversion(p, 20, 1.5),
    "mean_reversion_gated": lambda p: st.mean_reversion(p, 20, 1.5, gated=True, hurst_n=60),
    "random_entry": lambda p: st.random_entry(p, 7),
    "fixed_r_exit": lambda p: st.fixed_r_exit(st.ma_trend_filter(p, 50)),
    "percent_risk_size": lambda p: rounded(st.percent_risk_size(st.ma_trend_filter(p, 50)).select("series", "day", "position"), "position"),
    "carry": lambda p: st.carry(p.withColumn("rate", F.log(F.col("close") / F.col("open")) / 1000)),
}.items():
    query(_name, MACHINES.get(_name))(lambda spark, d, rule=_rule: rule(_prices(spark, d)).select("series", "day", "position"))


@query("pairs_coint")
def pairs_coint(spark, d):
    return rounded(st.pairs(pair(spark, d).select("series", "day", "x", "y")), "beta")


@query("pairs_ou")
def pairs_ou(spark, d):
    return rounded(st.pairs(pair(spark, d).select("series", "day", "x", "y"), model="ou"), "beta")


RUN = f"""{TREND}, b1 AS (SELECT *, close / lag(close) OVER w - 1 AS ret, coalesce(lag(position) OVER w, 0) AS traded FROM tf {W}), b2 AS (SELECT *, abs(traded - coalesce(lag(traded) OVER w, 0)) AS turnover, traded * coalesce(ret, 0) AS gross FROM b1 {W}),
bt AS (SELECT *, gross - turnover * 12.0 / 10000 AS net FROM b2)"""


@query("backtest_run", f"WITH {D}, {RUN}, e AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING)) AS equity FROM bt) SELECT series, day, traded, turnover, {sql_rounded('gross net equity')} FROM e")
def backtest_run(spark, d):
    return rounded(bt.run(_trend(spark, d)).select("series", "day", "traded", "turnover", "gross", "net", "equity"), "gross net equity")


@query("backtest_funding", f"WITH {D}, {TREND}, x AS (SELECT *, -ln(close / open) / 1000 AS ret, coalesce(lag(position) OVER w, 0) AS traded FROM tf {W}), y AS (SELECT *, traded * coalesce(ret, 0) - abs(traded - coalesce(lag(traded) OVER w, 0)) * 12.0 / 10000 AS net FROM x {W}) SELECT series, day, {sql_rounded('net', 8)} FROM y")
def backtest_funding(spark, d):
    return rounded(bt.run_funding(_trend(spark, d).withColumn("rate", F.log(F.col("close") / F.col("open")) / 1000)).select("series", "day", "net"), "net", 8)


@query("look_ahead", f"WITH {D}, {RUN}, pl AS (SELECT series, day, position, CASE WHEN dayofmonth(day) = 13 THEN position ELSE traded END AS traded FROM bt), lb AS (SELECT *, coalesce(lag(position) OVER w, 0) AS want FROM pl {W}) SELECT series, day FROM lb WHERE traded IS DISTINCT FROM want")
def look_ahead(spark, d):
    """A backtest with planted faults: on the 13th it trades the same day's position."""
    planted = bt.run(_trend(spark, d)).withColumn("traded", F.when(F.dayofmonth("day") == 13, F.col("position")).otherwise(F.col("traded")))
    return bt.look_ahead(planted).select("series", "day")


STATS = "n mean sharpe sortino vol cagr max_drawdown calmar hit_rate var5 cvar5 skew kurt"
STATS_SQL = """g AS (SELECT series, day, net, sum(ln(1 + net)) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING) AS g FROM {t}), dd AS (SELECT *, exp(g - greatest(max(g) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING), 0)) - 1 AS dd FROM g),
q AS (SELECT series, quantile_cont(net, 0.05) AS var5 FROM {t} GROUP BY 1),
s0 AS (SELECT series, count(*) AS n, avg(net) AS mean, stddev_samp(net) AS sd, sqrt(avg(power(least(net, 0), 2))) AS down, last(g ORDER BY day) AS gr, min(dd) AS max_drawdown, count(*) FILTER (net > 0) / nullif(count(*) FILTER (net <> 0), 0) AS hit_rate, min(var5) AS var5, avg(net) FILTER (net <= var5) AS cvar5, skewness(net) AS skew, kurtosis(net) + 3 AS kurt FROM dd JOIN q USING (series) GROUP BY 1),
st AS (SELECT *, mean / sd * sqrt(365) AS sharpe, mean / down * sqrt(365) AS sortino, sd * sqrt(365) AS vol, exp(gr * 365 / n) - 1 AS cagr, (exp(gr * 365 / n) - 1) / abs(max_drawdown) AS calmar FROM s0)"""


@query("backtest_stats", f"WITH {D}, {RUN}, {STATS_SQL.format(t='bt')} SELECT series, n, {sql_rounded(STATS[2:])} FROM st")
def backtest_stats(spark, d):
    return rounded(bt.stats(bt.run(_trend(spark, d)), ["series"]), STATS[2:])


FOLDS = "nf AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY series) AS m FROM bt)"


@query("walk_forward", f"WITH {D}, {RUN}, {FOLDS}, f AS (SELECT series, net, len(list_filter(range(1, 6), lambda k: i >= m * k // 6)) AS fold FROM nf) SELECT series, fold::INTEGER AS fold, count(*) AS n, round(avg(net) / stddev_samp(net) * sqrt(365), 6) + 0.0 AS sharpe FROM f WHERE fold > 0 GROUP BY 1, 2")
def walk_forward(spark, d):
    f = bt.walk_forward(_trend(spark, d), 5)
    return rounded(f.groupBy("series", "fold").agg(F.count("*").alias("n"), (F.avg("net") / F.stddev_samp("net") * 365**0.5).alias("sharpe")), "sharpe")


@query("cpcv", f"""WITH {D}, {RUN}, {FOLDS}, f AS (SELECT series, day, net, len(list_filter(range(1, 6), lambda k: i >= m * k // 6)) AS block FROM nf), p AS (SELECT *, row_number() OVER (PARTITION BY series, block ORDER BY day) AS j FROM f),
c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS combo, a, b FROM (SELECT unnest(range(6)) AS a) x, (SELECT unnest(range(6)) AS b) y WHERE a < b)
SELECT series, combo::INTEGER AS combo, count(*) AS n, round(avg(net) / stddev_samp(net) * sqrt(365), 6) + 0.0 AS sharpe FROM p JOIN c ON (block = a AND (a = 0 OR j > 5)) OR (block = b AND (b = a + 1 OR j > 5)) GROUP BY 1, 2""")
def cpcv(spark, d):
    return rounded(bt.cpcv(bt.run(_trend(spark, d)), 6, 2, embargo=5), "sharpe")


def _board(spark, d):
    """One series, several rules."""
    p = _prices(spark, d).filter("series = '1-URGENT'")
    rules = {"hold": p.withColumn("position", F.lit(1.0)), "trend20": st.ma_trend_filter(p, 20), "trend50": st.ma_trend_filter(p, 50), "mom": st.tsmom(p, 20, scaled=False)}
    out = None
    for name, x in rules.items():
        x = x.select("series", "day", "close", "position").withColumn("strategy", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return bt.run(out, keys=("strategy",)).select("strategy", "day", "net")


BOARD = f"""p AS (SELECT * FROM daily WHERE series = '1-URGENT'), m AS (SELECT *, {FULL('avg', 'close', 20)} AS s20, {FULL('avg', 'close', 50)} AS s50, close / lag(close, 20) OVER w - 1 AS mom FROM p {W}),
bd AS (SELECT 'hold' AS strategy, day, close, 1.0::DOUBLE AS position FROM m UNION ALL SELECT 'trend20', day, close, CAST(close > s20 AS DOUBLE) FROM m UNION ALL SELECT 'trend50', day, close, CAST(close > s50 AS DOUBLE) FROM m UNION ALL SELECT 'mom', day, close, CAST(mom > 0 AS DOUBLE) FROM m),
x1 AS (SELECT *, close / lag(close) OVER w - 1 AS ret, coalesce(lag(position) OVER w, 0) AS traded FROM bd WINDOW w AS (PARTITION BY strategy ORDER BY day)),
board AS (SELECT strategy, day, traded * coalesce(ret, 0) - abs(traded - coalesce(lag(traded) OVER w, 0)) * 12.0 / 10000 AS net FROM x1 WINDOW w AS (PARTITION BY strategy ORDER BY day))"""


@query("effective_trials", f"WITH {D}, {BOARD}, c AS (SELECT a.strategy AS a, b.strategy AS b, corr(a.net, b.net) AS c FROM board a JOIN board b USING (day) GROUP BY 1, 2) SELECT count(DISTINCT a) AS n, round(16 / sum(c * c), 6) + 0.0 AS n_eff FROM c")
def effective_trials(spark, d):
    return rounded(risk.effective_trials(_board(spark, d)), "n_eff")


@query("pbo", f"""WITH {D}, {BOARD}, nf AS (SELECT strategy, net, row_number() OVER (PARTITION BY strategy ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS m FROM board), fb AS (SELECT *, len(list_filter(range(1, 8), lambda k: i >= m * k // 8)) AS block FROM nf),
mo AS (SELECT strategy, block, count(net) AS n, sum(net) AS s, sum(net * net) AS ss FROM fb GROUP BY 1, 2), c AS (SELECT range AS c FROM range(256) WHERE bit_count(range) = 4),
g AS (SELECT c, strategy, (c >> block) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM mo, c GROUP BY 1, 2, 3), sr AS (SELECT c, strategy, inside, CASE WHEN ss - s * s / n > 0 THEN round(s / n / sqrt((ss - s * s / n) / (n - 1)), 12) ELSE 0 END AS sr FROM g),
w AS (SELECT c, strategy, max(sr) FILTER (inside = 1) AS a, max(sr) FILTER (inside = 0) AS b FROM sr GROUP BY 1, 2), best AS (SELECT c, b AS own FROM w QUALIFY row_number() OVER (PARTITION BY c ORDER BY a DESC, strategy) = 1),
r AS (SELECT c, avg(CAST(own > b AS DOUBLE)) AS rank FROM w JOIN best USING (c) GROUP BY 1) SELECT count(*) AS combos, avg(CAST(rank < 0.5 AS DOUBLE)) AS pbo FROM r""")
def pbo(spark, d):
    return bt.pbo(_board(spark, d))


@query("leaderboard")
def leaderboard(spark, d):
    s = risk.deflated(bt.stats(_board(spark, d), ["strategy"]), 4)
    return rounded(s.select("strategy", "n", "sharpe", "psr", "dsr"), "sharpe psr dsr")


@query("shrunk_sharpes", f"""WITH {D}, {BOARD}, s AS (SELECT strategy, avg(net) / stddev_samp(net) AS sharpe, 1.0 / count(*) AS variance FROM board GROUP BY 1), w AS (SELECT sum(1 / variance) AS sw, sum(power(1 / variance, 2)) AS sw2, sum(sharpe / variance) / sum(1 / variance) AS mu, count(*) AS k FROM s),
q AS (SELECT sum(power(sharpe - mu, 2) / variance) AS q FROM s, w), t AS (SELECT greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2 FROM w, q), mm AS (SELECT sum(sharpe / (variance + tau2)) / sum(1 / (variance + tau2)) AS mu FROM s, t)
SELECT strategy, round(sharpe, 6) + 0.0 AS sharpe, round(tau2, 8) + 0.0 AS tau2, round(mu, 6) + 0.0 AS mu, round(mu + tau2 / (tau2 + variance) * (sharpe - mu), 6) + 0.0 AS shrunk FROM s, t, mm""")
def shrunk_sharpes(spark, d):
    s = _board(spark, d).groupBy("strategy").agg((F.avg("net") / F.stddev_samp("net")).alias("sharpe"), (F.lit(1.0) / F.count("*")).alias("variance"))
    return rounded(rounded(risk.shrunk_sharpes(s), "sharpe mu shrunk"), "tau2", 8)


@query("evt_tail", f"""WITH {D}, {RETURNS}, l AS (SELECT series, -ret AS l FROM r WHERE ret IS NOT NULL), u AS (SELECT series, quantile_cont(l, 0.9) AS u, count(*) AS n FROM l GROUP BY 1),
x AS (SELECT series, l - u AS x, u, n, row_number() OVER (PARTITION BY series ORDER BY l) AS i, count(*) OVER (PARTITION BY series) AS m FROM l JOIN u USING (series) WHERE l > u),
g AS (SELECT series, max(m) AS exceed, max(u) AS u, max(n) AS n, avg(x) AS a0, avg(x * (m - i) / (m - 1)) AS a1 FROM x GROUP BY 1),
f AS (SELECT *, CASE WHEN exceed >= 30 AND 0.05 <= exceed / n AND a0 > 2 * a1 THEN 2 - a0 / (a0 - 2 * a1) END AS xi, CASE WHEN exceed >= 30 AND 0.05 <= exceed / n AND a0 > 2 * a1 THEN 2 * a0 * a1 / (a0 - 2 * a1) END AS beta FROM g),
v AS (SELECT *, u + beta / xi * (power(0.05 / (exceed / n), -xi) - 1) AS loss FROM f)
SELECT series, n, exceed, round(CASE WHEN exceed >= 30 THEN u END, 6) + 0.0 AS u, round(xi, 5) + 0.0 AS xi, round(beta, 5) + 0.0 AS beta, round(-loss, 5) + 0.0 AS var, round(CASE WHEN xi < 1 THEN -(loss + beta - xi * u) / (1 - xi) END, 5) + 0.0 AS es FROM v""")
def evt_tail(spark, d):
    t = risk.evt_tail(ft.return_features(_prices(spark, d)), ["series"], "ret", 0.9, 0.95).select("series", "n", "exceed", "u", "xi", "beta", "var", "es")
    return rounded(rounded(t, "u"), "xi beta var es", 5)


def _signals(spark, d):
    p = _prices(spark, d)
    return p.withColumn("signal", ft.zscore(F.col("close"), by("series", "day"), 20))


SIGNAL = f"sg AS (SELECT series, day, close, (close - {FULL('avg', 'close', 20)}) / ({FULL('stddev_samp', 'close', 20)}) AS signal, close > open AS mask FROM daily)"
FWD = "fw AS (SELECT *, lead(close, {k}) OVER w / close - 1 AS fwd FROM sg WINDOW w AS (PARTITION BY series ORDER BY day)), fk AS (SELECT {k} AS horizon, * FROM fw WHERE signal IS NOT NULL AND fwd IS NOT NULL)"
RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY signal) + (count(*) OVER (PARTITION BY {g}, signal) - 1) / 2.0 AS x, rank() OVER (PARTITION BY {g} ORDER BY fwd) + (count(*) OVER (PARTITION BY {g}, fwd) - 1) / 2.0 AS y FROM fk)"


@query("information_coefficient", f"WITH {D}, {SIGNAL}, {FWD.format(k=1)}, {RANKED.format(g='series')} SELECT series, count(*) AS n, round(corr(x, y), 6) + 0.0 AS ic FROM rk GROUP BY 1")
def information_coefficient(spark, d):
    return rounded(risk.information_coefficient(risk.forward_returns(_signals(spark, d)), ["series"]), "ic")


@query("ic_profile", f"WITH {D}, {SIGNAL}, fk AS (SELECT h.horizon, sg.*, lead(close, h.horizon) OVER (PARTITION BY series, h.horizon ORDER BY day) / close - 1 AS fwd FROM sg, (SELECT unnest([1, 3, 5, 10]) AS horizon) h) SELECT series, horizon, count(*) AS n, round(corr(signal, fwd), 6) + 0.0 AS ic FROM fk WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY 1, 2")
def ic_profile(spark, d):
    return rounded(risk.ic_profile(_signals(spark, d), method="pearson"), "ic")


@query("ic_blocks", f"""WITH {D}, sg0 AS (SELECT series, day, close, (close - {FULL('avg', 'close', 20)}) / ({FULL('stddev_samp', 'close', 20)}) AS signal FROM daily),
fw AS (SELECT *, lead(close) OVER (PARTITION BY series ORDER BY day) / close - 1 AS fwd FROM sg0), kn AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY day) - 1) // 21 AS block FROM fw WHERE signal IS NOT NULL AND fwd IS NOT NULL),
b AS (SELECT series, block, corr(signal, fwd) AS ic FROM kn GROUP BY 1, 2 HAVING count(*) = 21)
SELECT series, count(*) AS blocks, round(avg(ic), 6) + 0.0 AS mean, round(stddev_samp(ic), 6) + 0.0 AS sd, round(avg(ic) / stddev_samp(ic), 6) + 0.0 AS ir, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 6) + 0.0 AS t FROM b WHERE ic IS NOT NULL GROUP BY 1""")
def ic_blocks(spark, d):
    return rounded(risk.ic_blocks(_signals(spark, d), method="pearson"), "mean sd ir t")


@query("ic_significance", f"""WITH {D}, {SIGNAL}, {FWD.format(k=3)}, {RANKED.format(g='series')}, m AS (SELECT series, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, count(*) AS n FROM rk GROUP BY 1),
u AS (SELECT series, day, slope, sxx, n, (x - mx) * (y - my - slope * (x - mx)) AS u FROM rk JOIN m USING (series)), v AS (SELECT *, u * lag(u) OVER w AS c1, u * lag(u, 2) OVER w AS c2 FROM u WINDOW w AS (PARTITION BY series ORDER BY day))
SELECT series, min(n) AS n, round(min(slope), 6) + 0.0 AS slope, round(min(slope) * min(sxx) / sqrt(sum(u * u) + 2 * (1 - 1 / 3.0::DOUBLE) * sum(c1) + 2 * (1 - 2 / 3.0::DOUBLE) * sum(c2)), 6) + 0.0 AS t FROM v GROUP BY 1""")
def ic_significance(spark, d):
    return rounded(risk.ic_significance(_signals(spark, d), 3).select("series", "n", "slope", "t"), "slope t")


@query("regime_ic", f"WITH {D}, {SIGNAL}, {FWD.format(k=1)}, {RANKED.format(g='series, mask')} SELECT series, mask AS regime, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(x, y) END, 6) + 0.0 AS ic FROM rk GROUP BY 1, 2")
def regime_ic(spark, d):
    return rounded(risk.regime_ic(_signals(spark, d).withColumn("mask", F.col("close") > F.col("open"))), "ic")


LEDGER = f"""s AS (SELECT *, sign(traded) AS s, CASE WHEN sign(traded) IS NOT DISTINCT FROM lag(sign(traded)) OVER w THEN 0 ELSE 1 END AS f, {PRIOR('stddev_samp', 'ret', 20)} AS sd FROM bt {W}), t AS (SELECT *, CAST(sum(f) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trade FROM s),
p AS (SELECT *, exp(sum(ln(1 + gross)) OVER (PARTITION BY series, trade ORDER BY day ROWS UNBOUNDED PRECEDING)) - 1 AS p FROM t WHERE s <> 0),
l AS (SELECT series, trade, min(day) AS entry, max(day) AS exit, count(*) AS bars, last(p ORDER BY day) AS ret, min(p) AS mae, abs(first(traded ORDER BY day)) * 2 * first(sd ORDER BY day) AS risk FROM p GROUP BY 1, 2)"""


@query("trade_ledger", f"WITH {D}, {RUN}, {LEDGER} SELECT series, trade, entry, exit, bars, round(ret, 6) + 0.0 AS ret, round(mae, 6) + 0.0 AS mae, round(ret / risk, 6) + 0.0 AS r, round(mae / risk, 6) + 0.0 AS mae_r FROM l")
def trade_ledger(spark, d):
    return rounded(bt.trade_ledger(bt.run(_trend(spark, d))).select("series", "trade", "entry", "exit", "bars", "ret", "mae", "r", "mae_r"), "ret mae r mae_r")


@query("expectancy", f"""WITH {D}, {RUN}, {LEDGER}, k0 AS (SELECT series, trade, ret / risk AS r, mae / risk AS mae_r FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY trade) - row_number() OVER (PARTITION BY series, r > 0 ORDER BY trade) AS g FROM k0 WHERE r IS NOT NULL),
ls AS (SELECT series, max(n) AS loss_streak FROM (SELECT series, g, count(*) AS n FROM k WHERE r <= 0 GROUP BY 1, 2) GROUP BY 1)
SELECT series, count(*) AS trades, round(avg(CAST(r > 0 AS DOUBLE)), 6) + 0.0 AS win_rate, round(avg(r), 6) + 0.0 AS expectancy, round(avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r <= 0)), 6) + 0.0 AS payoff, round(avg(r) / stddev_samp(r) * sqrt(count(*)), 6) + 0.0 AS sqn,
round(sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r <= 0)), 6) + 0.0 AS profit_factor, round(avg(mae_r), 6) + 0.0 AS mae_r, coalesce(min(loss_streak), 0) AS loss_streak FROM k LEFT JOIN ls USING (series) GROUP BY 1""")
def expectancy(spark, d):
    return rounded(bt.expectancy(bt.trade_ledger(bt.run(_trend(spark, d))), ["series"]), "win_rate expectancy payoff sqn profit_factor mae_r")
