"""Queries of options, microstructure and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as sc
from tidemark.operators import asof, costs, micro
from tidemark.operators import options as op
from tidemark.plans.registry import query, rounded, sql_rounded
from tidemark.sources.schemas import CHAIN_SQL, DAY_MS, TAPE_SQL, chain, tape

T, C = f"WITH {TAPE_SQL}", f"WITH {CHAIN_SQL}"
FORWARD = "fo AS (SELECT expiry_days, quantile_cont(strike, 0.5) AS forward FROM chain GROUP BY 1), cf AS (SELECT chain.*, forward, expiry_days / 365 AS t FROM chain JOIN fo USING (expiry_days))"
LADDER = "hs AS (SELECT *, CASE WHEN opt_type = 'C' THEN strike >= forward ELSE strike <= forward END AS otm FROM cf WHERE iv > 0 AND strike > 0), ld AS (SELECT expiry_days, strike, avg(iv) AS iv, min(forward) AS forward, min(t) AS t FROM (SELECT *, bool_or(otm) OVER (PARTITION BY expiry_days) AS has FROM hs) WHERE otm OR NOT has GROUP BY 1, 2)"


def _chain(spark, d):
    return op.with_forward(chain(spark, d))


@query("option_forward", f"{C}, {FORWARD} SELECT expiry_days, count(*) AS n, round(min(forward), 6) + 0.0 AS forward FROM cf GROUP BY 1")
def option_forward(spark, d):
    return rounded(_chain(spark, d).groupBy("expiry_days").agg(F.count("*").alias("n"), F.min("forward").alias("forward")), "forward")


@query("otm_ladder", f"{C}, {FORWARD}, {LADDER} SELECT expiry_days, strike, {sql_rounded('iv')} FROM ld")
def otm_ladder(spark, d):
    return rounded(op.otm_ladder(_chain(spark, d)).select("expiry_days", "strike", "iv"), "iv")


@query("black76_gamma_vega", f"""{C}, {FORWARD}, g AS (SELECT p_partkey, forward, iv, t, (ln(forward / strike) + iv * iv * t / 2) / (iv * sqrt(t)) AS d1 FROM cf WHERE iv > 0)
SELECT p_partkey, round(exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (forward * iv * sqrt(t)), 8) + 0.0 AS gamma, round(forward * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(t), 6) + 0.0 AS vega FROM g""")
def black76_gamma_vega(spark, d):
    return rounded(rounded(op.greeks(_chain(spark, d)).filter("iv > 0").select("p_partkey", "gamma", "vega"), "gamma", 8), "vega")


@query("black76_delta")
def black76_delta(spark, d):
    return rounded(op.greeks(_chain(spark, d)).select("p_partkey", "delta"), "delta")


@query("option_surface")
def option_surface(spark, d):
    return rounded(op.surface(_chain(spark, d)), "t forward atm_iv skew_25d")


@query("option_smile")
def option_smile(spark, d):
    return rounded(op.smile(_chain(spark, d)), "log_moneyness delta iv")


@query("iv_at_term")
def iv_at_term(spark, d):
    return rounded(op.iv_at(op.surface(_chain(spark, d)), 0.2), "iv")


@query("max_pain", f"""{C}, s AS (SELECT DISTINCT expiry_days, strike AS k FROM chain), p AS (SELECT s.expiry_days, k, round(sum(oi * CASE WHEN opt_type = 'C' THEN greatest(k - strike, 0) ELSE greatest(strike - k, 0) END), 6) AS pain FROM s JOIN chain c ON s.expiry_days = c.expiry_days GROUP BY 1, 2),
r AS (SELECT expiry_days, sum(oi) FILTER (opt_type = 'P') / sum(oi) FILTER (opt_type = 'C') AS put_call FROM chain GROUP BY 1) SELECT p.expiry_days, first(k ORDER BY pain, k) AS max_pain, round(min(put_call), 6) + 0.0 AS put_call FROM p JOIN r ON p.expiry_days = r.expiry_days GROUP BY 1""")
def max_pain(spark, d):
    return rounded(op.max_pain(chain(spark, d)), "put_call")


@query("gamma_concentration", f"""{C}, {FORWARD}, g AS (SELECT expiry_days, strike, oi, forward, iv, t, (ln(forward / strike) + iv * iv * t / 2) / (iv * sqrt(t)) AS d1 FROM cf WHERE iv > 0)
SELECT expiry_days, strike, round(sum(oi * exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (forward * iv * sqrt(t))), 6) + 0.0 AS gamma_oi FROM g GROUP BY 1, 2""")
def gamma_concentration(spark, d):
    return rounded(op.gamma_concentration(_chain(spark, d)), "gamma_oi")


NAMES = "nm AS (SELECT p_partkey, concat('BTC-', p_size % 28 + 1, ['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC','XXX'][p_partkey % 13 + 1], '25-', CAST(floor(p_retailprice) AS BIGINT), '-', CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END) AS name, p_partkey % 13 + 1 AS m, p_size % 28 + 1 AS dd, CAST(floor(p_retailprice) AS BIGINT) AS k FROM part)"


@query("parse_instrument", f"WITH {NAMES} SELECT name, CASE WHEN m <= 12 THEN epoch_ms(make_date(2025, CAST(m AS INTEGER), dd)) + 28800000 END AS expiry_ms, CASE WHEN m <= 12 THEN CAST(k AS DOUBLE) END AS strike, CASE WHEN m <= 12 THEN name[-1:] END AS opt_type FROM nm")
def parse_instrument(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    month = F.element_at(F.array(*map(F.lit, [*op.MONTHS, "XXX"])), (F.col("p_partkey") % 13 + 1).cast("int"))
    name = F.concat(F.lit("BTC-"), F.col("p_size") % 28 + 1, month, F.lit("25-"), F.floor("p_retailprice").cast("string"), F.lit("-"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P"))
    x = p.select(name.alias("name")).withColumn("i", op.parse_instrument(F.col("name")))
    return x.select("name", "i.expiry_ms", "i.strike", "i.opt_type")


def _changes(spark, d):
    """Price changes; ts orders prints of one instant by their ids, however the files are read and shuffled. Prints without a time come last, as in the SQL."""
    ms = F.coalesce("ts_ms", F.lit(2**63 - 1))
    t = tape(spark, d).select(F.col("exchange").alias("series"), F.struct(ms.alias("ts_ms"), F.col("trade_id").cast("long").alias("id")).alias("ts"), F.col("price").alias("p"))
    from tidemark.functions.windows import by

    return t.withColumn("dp", F.col("p") - F.lag("p").over(by("series", "ts")))


COV = "cv AS (SELECT exchange AS series, ts_ms AS ts, price AS p, price - lag(price) OVER (PARTITION BY exchange ORDER BY ts_ms) AS dp FROM tape), e AS (SELECT series, ts, dp - avg(dp) OVER (PARTITION BY series) AS e FROM cv WHERE dp IS NOT NULL), l AS (SELECT *, lag(e) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM e WINDOW w AS (PARTITION BY series ORDER BY ts)), gm AS (SELECT series, count(*) AS n, sum(e * e) / count(*) AS g0, sum(e * e1) / count(*) AS g1, sum(e * e2) / count(*) AS g2, sum(e * e3) / count(*) AS g3 FROM l GROUP BY 1)"


@query("autocovariances", f"{T}, {COV} SELECT series, n, {sql_rounded('g0 g1 g2 g3')} FROM gm")
def autocovariances(spark, d):
    """A lag that no pair of changes spans is NULL."""
    g = micro.autocovariances(_changes(spark, d), 3)
    return rounded(g.select("series", "n", *[F.when(F.col("n") > k, F.element_at("g", k + 1)).alias(f"g{k}") for k in range(4)]), "g0 g1 g2 g3")


@query("acf", f"{T}, {COV} SELECT series, round(g1 / g0, 6) + 0.0 AS r1, round(g2 / g0, 6) + 0.0 AS r2, round(g3 / g0, 6) + 0.0 AS r3 FROM gm")
def acf(spark, d):
    g = micro.acf(micro.autocovariances(_changes(spark, d), 3))
    return rounded(g.select("series", *[F.element_at("acf", k + 1).alias(f"r{k}") for k in (1, 2, 3)]), "r1 r2 r3")


@query("roll_spread", f"{T}, {COV} SELECT series, round(CASE WHEN g1 < 0 THEN sqrt(-g1) END, 6) + 0.0 AS c, round(CASE WHEN g1 < 0 THEN g0 + 2 * g1 END, 6) + 0.0 AS sigma2_w FROM gm")
def roll_spread(spark, d):
    r = micro.roll(micro.autocovariances(_changes(spark, d), 10), force=True)
    return rounded(r.select("series", "c", "sigma2_w"), "c sigma2_w")


@query("roll_bounds", f"""{T}, ch AS (SELECT exchange AS series, ts_ms, price - lag(price) OVER (PARTITION BY exchange ORDER BY ts_ms) AS dp FROM tape), e AS (SELECT series, dp - avg(dp) OVER (PARTITION BY series) AS e, ts_ms FROM ch WHERE dp IS NOT NULL),
lg AS (SELECT series, e, {', '.join(f'lag(e, {k}) OVER w AS l{k}' for k in range(1, 11))} FROM e WINDOW w AS (PARTITION BY series ORDER BY ts_ms)),
m AS (SELECT series, count(*) AS n, sum(e * e) / count(*) AS g0, {', '.join(f'sum(e * l{k}) / count(*) AS g{k}' for k in range(1, 11))} FROM lg GROUP BY 1),
i AS (SELECT *, CASE WHEN g0 * g0 >= 4 * g1 * g1 THEN sqrt(g0 * g0 - 4 * g1 * g1) END AS d FROM m)
SELECT series, round(n * (n + 2) * ({' + '.join(f'(g{k} / g0) ** 2 / (n - {k})' for k in range(2, 11))}) / (1 + 2 * (g1 / g0) ** 2), 6) + 0.0 AS q, round(g1 / ((g0 + d) / 2), 6) + 0.0 AS theta, round((1 + g1 / ((g0 + d) / 2)) ** 2 * (g0 + d) / 2, 6) + 0.0 AS sigma2_wold, round((g0 - d) / 2, 6) + 0.0 AS bound,
round(CASE WHEN g1 < 0 THEN sqrt((g0 - d) / 2) END, 6) + 0.0 AS c_low, round(CASE WHEN g1 < 0 AND d IS NOT NULL THEN sqrt(-g1) END, 6) + 0.0 AS c_high FROM i""")
def roll_bounds(spark, d):
    """The figures of the MA(1) reading, whatever its gate says."""
    names = "q theta sigma2_wold bound c_low c_high"
    return rounded(micro.roll(micro.autocovariances(_changes(spark, d), 10), force=True).select("series", *names.split()), names)


@query("roll_gate")
def roll_gate(spark, d):
    return rounded(micro.roll(micro.autocovariances(_changes(spark, d), 10)).select("series", "q", "critical", "passes", "verdict", "c", "sigma2_wold", "c_low", "c_high"), "q critical c sigma2_wold c_low c_high")


@query("sigma2_variance_ratio", f"""{T}, d AS (SELECT exchange AS series, price - lag(price, 8) OVER w AS d8, price - lag(price, 16) OVER w AS d16, price - lag(price, 32) OVER w AS d32 FROM tape WINDOW w AS (PARTITION BY exchange ORDER BY ts_ms)),
v AS (SELECT series, unnest([1 / 8.0, 1 / 16.0, 1 / 32.0])::DOUBLE AS x, unnest([var_samp(d8) / 8, var_samp(d16) / 16, var_samp(d32) / 32]) AS y FROM d GROUP BY series) SELECT series, round(regr_intercept(y, x), 6) + 0.0 AS sigma2_w, round(regr_slope(y, x), 6) + 0.0 AS slope FROM v GROUP BY 1""")
def sigma2_variance_ratio(spark, d):
    return rounded(micro.variance_intercept(_changes(spark, d), [8, 16, 32]), "sigma2_w slope")


@query("sigma2_ar")
def sigma2_ar(spark, d):
    return rounded(micro.ar_variance(micro.autocovariances(_changes(spark, d), 10), 10).select("series", "n", "sigma2_ar"), "sigma2_ar")


@query("roll_by_blocks")
def roll_by_blocks(spark, d):
    return rounded(micro.by_blocks(_changes(spark, d), 20), "mean se")


@query("segment_moments", f"""{T}, s AS (SELECT exchange, ts_ms // {DAY_MS} AS day, ts_ms // 3600000 AS hour, CAST(trade_id AS BIGINT) AS id, CASE WHEN aggressor_buy THEN 1 ELSE -1 END AS sign FROM tape),
p AS (SELECT *, CASE WHEN NOT coalesce(id - lag(id) OVER w > 10 OR hour <> lag(hour) OVER w, true) THEN lag(sign) OVER w END AS prev FROM s WINDOW w AS (PARTITION BY exchange ORDER BY id))
SELECT exchange, day, count(sign) AS n0, CAST(sum(sign) AS DOUBLE) AS s0, CAST(sum(sign * sign) AS DOUBLE) AS ssq, count(prev) AS n1, CAST(sum(sign * prev) AS DOUBLE) AS s1 FROM p GROUP BY 1, 2""")
def segment_moments(spark, d):
    t = tape(spark, d).select("exchange", F.floor(F.col("ts_ms") / DAY_MS).cast("long").alias("day"), F.floor(F.col("ts_ms") / 3_600_000).alias("hour"), F.col("trade_id").cast("long").alias("id"), F.when(F.col("aggressor_buy"), 1.0).otherwise(-1.0).alias("sign"))
    return micro.segment_moments(t, 10)


@query("markout", f"""{T}, c AS (SELECT trade_id, ts_ms, price, CASE WHEN aggressor_buy THEN 1 ELSE -1 END AS s FROM tape WHERE exchange = 'click'), h AS (SELECT unnest([0, 600000, 3600000]) AS horizon), r AS (SELECT ts_ms AS at_ms, price AS at_price FROM tape WHERE exchange = 'view'), q AS (SELECT *, ts_ms + horizon AS want FROM c, h)
SELECT horizon, count(at_price) AS n, round(avg(s * (at_price - price)), 6) + 0.0 AS markout FROM (SELECT q.*, CASE WHEN at_ms - want <= 3600000 THEN at_price END AS at_price FROM q ASOF LEFT JOIN r ON q.want < r.at_ms) GROUP BY 1""")
def markout(spark, d):
    t = tape(spark, d)
    c = t.filter("exchange = 'click'").select("symbol", "ts_ms", "price", F.when(F.col("aggressor_buy"), 1).otherwise(-1).alias("s"))
    c = c.withColumn("horizon", F.explode(F.array(*map(F.lit, (0, 600_000, 3_600_000))))).withColumn("want", F.col("ts_ms") + F.col("horizon"))
    r = t.filter("exchange = 'view'").select("symbol", F.col("ts_ms").alias("at_ms"), F.col("price").alias("at_price"), F.col("trade_id").cast("long").alias("at_id"))
    j = asof.asof_join(c, r, ["symbol"], "want", "at_ms", forward=True, strict=True, tolerance=3_600_000, ties=("at_id",))
    return rounded(j.groupBy("horizon").agg(F.count("at_price").alias("n"), F.avg(F.col("s") * (F.col("at_price") - F.col("price"))).alias("markout")), "markout")


@query("cost_model", """WITH o AS (SELECT o_orderkey, o_totalprice AS notional, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 3 + 1.0 END AS fee_bps, CASE WHEN o_orderkey % 2 = 0 THEN 'taker' ELSE 'maker' END AS order_type, CASE WHEN o_orderkey % 3 = 0 THEN 'spot' ELSE 'perp' END AS instrument, o_orderkey % 30 AS days_held,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS side, CASE WHEN o_orderkey % 13 <> 0 THEN 0.5 END AS half_spread_bps, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 17 <> 0 THEN 1.5 END AS funding_bps_day FROM orders),
i AS (SELECT *, CASE WHEN notional <= 100000 THEN 1.0 WHEN notional <= 300000 THEN 2.5 WHEN notional <= 400000 THEN 6.0 END AS impact_bps FROM o),
r AS (SELECT *, CASE WHEN fee_bps IS NULL THEN 'fee' WHEN instrument = 'perp' AND funding_bps_day IS NULL THEN 'funding' WHEN order_type = 'taker' AND half_spread_bps IS NULL THEN 'half-spread' WHEN order_type = 'taker' AND impact_bps IS NULL THEN 'impact' END AS refused FROM i)
SELECT o_orderkey, refused, CASE WHEN refused IS NULL THEN CAST(fee_bps + CASE WHEN order_type = 'taker' THEN half_spread_bps + impact_bps ELSE 0 END AS DOUBLE) END AS bps_per_leg, CASE WHEN refused IS NULL THEN CAST(CASE WHEN instrument = 'perp' THEN -side * funding_bps_day * days_held ELSE 0 END AS DOUBLE) + 0.0::DOUBLE END AS bps_carry, CASE WHEN refused IS NULL THEN CAST(2 AS DOUBLE) END AS bps_tax FROM r""")
def cost_model(spark, d):
    key = F.col("o_orderkey")
    o = spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", F.col("o_orderpriority").alias("venue"), F.col("o_totalprice").alias("notional"), F.when(key % 11 != 0, (key % 3 + 1).cast("double")).alias("fee_bps"), F.when(key % 2 == 0, "taker").otherwise("maker").alias("order_type"),
        F.when(key % 3 == 0, "spot").otherwise("perp").alias("instrument"), (key % 30).alias("days_held"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("side"), F.when(key % 13 != 0, 0.5).alias("half_spread_bps"),
        F.when((key % 3 != 0) & (key % 17 != 0), 1.5).alias("funding_bps_day"), F.lit(2.0).alias("tax_bps"),
    )
    steps = o.select("venue").distinct().withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("notional"), F.lit(b).alias("impact_bps")) for n, b in ((1e5, 1.0), (3e5, 2.5), (4e5, 6.0))]))).select("venue", "s.*")
    got = costs.cost_model(costs.with_impact(o, steps))
    return got.select("o_orderkey", "refused", "bps_per_leg", (F.col("bps_carry") + F.lit(0.0)).alias("bps_carry"), "bps_tax")


@query("weighted_quantiles", """WITH g AS (SELECT l_returnflag AS k, l_discount AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, (sum(w) OVER (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY k) AS p FROM g),
n AS (SELECT *, lead(p) OVER o AS np, lead(x) OVER o AS nx, row_number() OVER o AS r FROM c WINDOW o AS (PARTITION BY k ORDER BY x)), q AS (SELECT *, unnest([0.001, 0.25, 0.5, 0.95, 0.999])::DOUBLE AS q FROM n)
SELECT k, q, round(CASE WHEN q >= p AND q < np THEN x + (nx - x) * (q - p) / (np - p) ELSE x END, 6) + 0.0 AS value FROM q WHERE (q >= p AND q < np) OR (r = 1 AND q < p) OR (np IS NULL AND q >= p)""")
def weighted_quantiles(spark, d):
    i = spark.read.parquet(f"{d}/lineitem.parquet").withColumnRenamed("l_returnflag", "k")
    return rounded(costs.weighted_quantiles(i, ["k"], "l_discount", "l_quantity", [0.001, 0.25, 0.5, 0.95, 0.999]), "value")


SETTLED = "st AS (SELECT exchange, round(ts_ms / 28800000)::BIGINT * 28800000 AS slot, ts_ms, price AS rate FROM tape), ss AS (SELECT exchange, slot, first(rate ORDER BY abs(ts_ms - slot), ts_ms) AS rate, count(*) AS n FROM st WHERE abs(ts_ms - slot) <= 3000000 GROUP BY 1, 2)"


@query("settled_rates", f"{T}, {SETTLED} SELECT * FROM ss")
def settled_rates(spark, d):
    return costs.settled_rates(tape(spark, d).withColumnRenamed("price", "rate"), 28_800_000, 3_000_000)


@query("missed_slots", f"{T}, {SETTLED}, a AS (SELECT slot, rate FROM ss WHERE exchange = 'click'), b AS (SELECT slot, rate FROM ss WHERE exchange = 'error') SELECT a.slot, a.rate AS rate FROM a ANTI JOIN b ON a.slot = b.slot")
def missed_slots(spark, d):
    s = costs.settled_rates(tape(spark, d).withColumnRenamed("price", "rate"), 28_800_000, 3_000_000)
    return s.filter("exchange = 'click'").join(s.filter("exchange = 'error'").select("slot"), "slot", "left_anti").select("slot", "rate")


@query("calendar_keys", f"{T} SELECT trade_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(ts_ms * 1000), '%Y-%m') AS month, strftime(make_timestamp(ts_ms * 1000), '%G-W%V') AS week, list_filter([CASE WHEN h < 8 THEN 'asia' END, CASE WHEN h >= 7 AND h < 16 THEN 'london' END, CASE WHEN h >= 12 AND h < 21 THEN 'new_york' END], lambda x: x IS NOT NULL) AS sessions FROM (SELECT *, (ts_ms % {DAY_MS}) // 3600000 AS h FROM tape)")
def calendar_keys(spark, d):
    ts = F.col("ts_ms")
    return tape(spark, d).select("trade_id", sc.utc_day(ts).alias("day"), sc.month_of_ms(ts).alias("month"), sc.iso_week(ts).alias("week"), sc.sessions_of(ts).alias("sessions"))


@query("tick_and_tier", f"{T} SELECT trade_id, round(floor(round(price / 0.5, 9)) * 0.5, 10) AS down, round(ceil(round(price / 0.5, 9)) * 0.5, 10) AS up, CASE WHEN price * qty <= 10000 THEN 0 WHEN price * qty <= 100000 THEN 1 WHEN price * qty <= 1000000 THEN 2 ELSE 3 END AS tier FROM tape")
def tick_and_tier(spark, d):
    return tape(spark, d).select("trade_id", sc.snap(F.col("price"), 0.5).alias("down"), sc.snap(F.col("price"), 0.5, True).alias("up"), sc.size_tier(F.col("price") * F.col("qty")).alias("tier"))


