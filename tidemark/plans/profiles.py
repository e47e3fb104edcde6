"""Queries of volume profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars, profiles as pf
from tidemark.plans.registry import query, rounded, sql_rounded
from tidemark.sources.schemas import DAY_MS, SHIP_SQL, TAPE_SQL, ship_tape, tape

T, S = f"WITH {TAPE_SQL}", f"WITH {SHIP_SQL}"
PROF = """prof AS (SELECT exchange, round(round(price / 10) * 10, 9) AS level, sum(CASE WHEN aggressor_buy THEN qty ELSE 0 END) AS buy, sum(CASE WHEN NOT aggressor_buy THEN qty ELSE 0 END) AS sell, sum(qty) AS volume, count(*) AS prints, sum(price * qty) AS notional FROM tape GROUP BY 1, 2)"""


@query("volume_profile", f"{T}, {PROF} SELECT exchange, level, buy, sell, volume, prints, {sql_rounded('notional')} FROM prof")
def volume_profile(spark, d):
    return rounded(pf.profile(tape(spark, d), 10.0, ["exchange"]).select("exchange", "level", "buy", "sell", "volume", "prints", "notional"), "notional")


@query("volume_profile_dedup", f"""{S}, u AS (SELECT * FROM ship QUALIFY row_number() OVER (PARTITION BY exchange, symbol, trade_id ORDER BY ts_ms, price, qty) = 1)
SELECT exchange, round(round(price / 100) * 100, 9) AS level, sum(qty) AS volume, count(*) AS prints, sum(CASE WHEN price * qty <= 10000 THEN qty ELSE 0 END) AS vol_small, sum(CASE WHEN price * qty > 10000 AND price * qty <= 100000 THEN qty ELSE 0 END) AS vol_medium FROM u GROUP BY 1, 2""")
def volume_profile_dedup(spark, d):
    return pf.profile(ship_tape(spark, d), 100.0, ["exchange"]).select("exchange", "level", "volume", "prints", "vol_small", "vol_medium")


AREA = """lv AS (SELECT {k}, level, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY level) AS i, count(*) OVER (PARTITION BY {k}) AS m, sum({v}) OVER (PARTITION BY {k}) AS total FROM {t}),
top AS (SELECT {k}, arg_min(i, i) AS i, min(m) AS m, min(total) AS total, min(v) AS v FROM (SELECT * FROM lv QUALIFY v = max(v) OVER (PARTITION BY {k})) GROUP BY {k}),
walk AS (SELECT {k}, i AS poc, i AS lo, i AS hi, v, m, total, 0 AS s FROM top UNION ALL
    SELECT {wk}, w.poc, CASE WHEN up THEN w.lo ELSE w.lo - 1 END, CASE WHEN up THEN w.hi + 1 ELSE w.hi END, w.v + CASE WHEN up THEN uv ELSE dv END, w.m, w.total, w.s + 1
    FROM (SELECT w.*, u.v AS uv, dn.v AS dv, w.hi < w.m AND (w.lo = 1 OR coalesce(u.v, 0) >= coalesce(dn.v, 0)) AS up FROM walk w LEFT JOIN lv u ON {wu} AND u.i = w.hi + 1 LEFT JOIN lv dn ON {wd} AND dn.i = w.lo - 1 WHERE w.v < 0.7 * w.total - 1e-9 AND (w.hi < w.m OR w.lo > 1)) w),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY s DESC) = 1),
area AS (SELECT {ek}, p.level AS poc, h.level AS vah, l.level AS val, e.total AS volume FROM ends e JOIN lv p ON {ep} AND p.i = e.poc JOIN lv h ON {eh} AND h.i = e.hi JOIN lv l ON {el} AND l.i = e.lo)"""


def area_sql(table: str, keys: list[str], volume: str = "volume") -> str:
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return AREA.format(k=", ".join(keys), v=volume, t=table, wk=", ".join(f"w.{k}" for k in keys), wu=on("u", "w"), wd=on("dn", "w"), ek=", ".join(f"e.{k}" for k in keys), ep=on("p", "e"), eh=on("h", "e"), el=on("l", "e"))


@query("value_area", f"{T.replace('WITH', 'WITH RECURSIVE')}, {PROF}, {area_sql('prof', ['exchange'])} SELECT * FROM area")
def value_area(spark, d):
    return pf.value_area(pf.profile(tape(spark, d), 10.0, ["exchange"]), ["exchange"])


DAYS = f"""dp AS (SELECT exchange, ts_ms // {DAY_MS} AS day, round(round(price / 10) * 10, 9) AS level, sum(qty) AS volume FROM tape GROUP BY 1, 2, 3),
oh AS (SELECT exchange, ts_ms // {DAY_MS} AS day, first(price ORDER BY ts_ms, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_ms, trade_id) AS close FROM tape GROUP BY 1, 2)"""
LEVELS = f"{T.replace('WITH', 'WITH RECURSIVE')}, {DAYS}, {area_sql('dp', ['exchange', 'day'])}, dl AS (SELECT * FROM oh JOIN area USING (exchange, day))"


@query("day_levels", f"{LEVELS} SELECT * FROM dl")
def day_levels(spark, d):
    return pf.day_levels(tape(spark, d), 10.0)


@query("naked_levels", f"{LEVELS} SELECT exchange, day, poc FROM dl a WHERE NOT EXISTS (SELECT 1 FROM dl b WHERE b.exchange = a.exchange AND b.day > a.day AND a.poc BETWEEN b.low AND b.high)")
def naked_levels(spark, d):
    return pf.naked(pf.day_levels(tape(spark, d), 10.0)).select("exchange", "day", "poc")


@query("value_migration", f"""{LEVELS}, p AS (SELECT *, lag(vah) OVER w AS h0, lag(val) OVER w AS l0, lag(poc) OVER w AS p0 FROM dl WINDOW w AS (PARTITION BY exchange ORDER BY day))
SELECT exchange, day, CASE WHEN vah = h0 AND val = l0 THEN 'unchanged' WHEN val > h0 THEN 'higher' WHEN vah < l0 THEN 'lower' WHEN vah <= h0 AND val >= l0 THEN 'inside' WHEN vah >= h0 AND val <= l0 THEN 'outside' WHEN vah > h0 THEN 'overlapping_higher' ELSE 'overlapping_lower' END AS kind,
greatest(least(vah, h0) - greatest(val, l0), 0) AS overlap, poc - p0 AS poc_shift FROM p WHERE h0 IS NOT NULL""")
def value_migration(spark, d):
    return pf.value_migration(pf.day_levels(tape(spark, d), 10.0))


@query("vwap_sigma", f"{T}, v AS (SELECT exchange, sum(price * qty) / sum(qty) AS vwap, sum(qty) AS volume, count(*) AS n FROM tape GROUP BY 1) SELECT exchange, round(min(vwap), 6) + 0.0 AS vwap, min(volume) AS volume, min(n) AS n, round(sqrt(sum(qty * power(price - vwap, 2)) / sum(qty)), 6) + 0.0 AS sigma FROM tape JOIN v USING (exchange) GROUP BY 1")
def vwap_sigma(spark, d):
    return rounded(pf.vwap_sigma(tape(spark, d), ["exchange"]), "vwap sigma")


@query("anchored_vwap", f"""{T}, x AS (SELECT exchange, trade_id, CASE WHEN sum(qty) OVER w <> 0 THEN sum(price * qty) OVER w / sum(qty) OVER w END AS vwap, CASE WHEN sum(qty) OVER w <> 0 THEN sum(price * price * qty) OVER w / sum(qty) OVER w END AS m2 FROM tape WINDOW w AS (PARTITION BY exchange, ts_ms // {DAY_MS} ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING))
SELECT exchange, trade_id, round(vwap, 6) + 0.0 AS vwap FROM x""")
def anchored_vwap(spark, d):
    t = tape(spark, d).withColumn("day", bars.bar_of("ts_ms", DAY_MS))
    return rounded(pf.anchored_vwap(t, ["exchange", "day"]).select("exchange", "trade_id", "vwap"), "vwap")


HOURLY = "hb AS (SELECT exchange, ts_ms // 3600000 * 3600000 AS ts_ms, max(price) AS high, min(price) AS low, sum(qty) AS volume FROM tape GROUP BY 1, 2)"


def _hourly(spark, d):
    return bars.trade_bars(tape(spark, d), 3_600_000).withColumn("ts_ms", F.col("bar") * 3_600_000)


@query("kline_profile", f"""{T}, {HOURLY}, sp AS (SELECT exchange, min(low) AS lo, (max(high) - min(low)) / 50 AS step FROM hb GROUP BY 1),
x AS (SELECT exchange, volume, least(CAST(floor((low - lo) / step) AS BIGINT), 49) AS a, least(CAST(floor((high - lo) / step) AS BIGINT), 49) AS b FROM hb JOIN sp USING (exchange)),
y AS (SELECT exchange, volume / (b - a + 1) AS v, unnest(range(a, b + 1)) AS bucket FROM x) SELECT exchange, bucket, round(sum(v), 6) + 0.0 AS volume FROM y GROUP BY 1, 2""")
def kline_profile(spark, d):
    return rounded(pf.kline_profile(_hourly(spark, d), 50, ["exchange"]).select("exchange", "bucket", "volume"), "volume")


TPO = f"""{HOURLY}, tp AS (SELECT exchange, ts_ms // {DAY_MS} AS day, level, list_sort(list(DISTINCT period)) AS periods FROM (SELECT exchange, ts_ms, CAST((ts_ms % {DAY_MS}) // 3600000 AS INTEGER) AS period, unnest(range(CAST(floor(low / 10) AS BIGINT), CAST(floor(high / 10) AS BIGINT) + 1)) AS level FROM hb) GROUP BY 1, 2, 3)"""


@query("tpo", f"{T}, {TPO} SELECT exchange, day, level, len(periods) AS n, periods[1] AS first_period FROM tp")
def tpo(spark, d):
    t = pf.tpo(_hourly(spark, d), 10.0, 3_600_000)
    return t.select("exchange", "day", "level", F.size("periods").cast("long").alias("n"), F.element_at("periods", 1).alias("first_period"))


@query("tpo_summary", f"""{T.replace('WITH', 'WITH RECURSIVE')}, {TPO}, tn AS (SELECT exchange, day, level, len(periods)::DOUBLE AS n, periods FROM tp), {area_sql('tn', ['exchange', 'day'], 'n')},
md AS (SELECT exchange, day, (min(level) + max(level)) / 2 AS mid, min(periods[1]) AS f FROM tp GROUP BY 1, 2), tt AS (SELECT tn.*, mid, f, list_min(periods) <= f + 1 AS op FROM tn JOIN md USING (exchange, day))
SELECT tt.exchange, tt.day, first(level ORDER BY n DESC, abs(level - mid), level) AS poc, count(*) FILTER (n = 1) AS singles, max(level) FILTER (op) AS ib_high, min(level) FILTER (op) AS ib_low, min(area.vah) AS vah, min(area.val) AS val FROM tt JOIN area ON tt.exchange = area.exchange AND tt.day = area.day GROUP BY 1, 2""")
def tpo_summary(spark, d):
    return pf.tpo_summary(pf.tpo(_hourly(spark, d), 10.0, 3_600_000)).select("exchange", "day", "poc", "singles", "ib_high", "ib_low", "vah", "val")


FOOT = f"""fp0 AS (SELECT exchange, ts_ms // {DAY_MS} AS bar, CAST(floor(round(price / 5, 9)) AS BIGINT) AS level, sum(CASE WHEN aggressor_buy THEN qty ELSE 0 END) AS buy, sum(CASE WHEN NOT aggressor_buy THEN qty ELSE 0 END) AS sell FROM tape GROUP BY 1, 2, 3),
fp AS (SELECT *, buy > 0 AND buy >= 3 * CASE WHEN lag(level) OVER w = level - 1 THEN lag(sell) OVER w ELSE 0 END AS buy_imbalance, sell > 0 AND sell >= 3 * CASE WHEN lead(level) OVER w = level + 1 THEN lead(buy) OVER w ELSE 0 END AS sell_imbalance FROM fp0 WINDOW w AS (PARTITION BY exchange, bar ORDER BY level))"""


@query("footprint", f"{T}, {FOOT} SELECT * FROM fp")
def footprint(spark, d):
    return pf.footprint(tape(spark, d), DAY_MS, 5.0)


@query("footprint_bars", f"""{T}, x AS (SELECT exchange, ts_ms // {DAY_MS} AS bar, ts_ms, trade_id, sum(CASE WHEN aggressor_buy THEN qty ELSE -qty END) OVER (PARTITION BY exchange, ts_ms // {DAY_MS} ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS c FROM tape)
SELECT exchange, bar, last(c ORDER BY ts_ms, trade_id) AS delta, least(min(c), 0) AS delta_min, greatest(max(c), 0) AS delta_max FROM x GROUP BY 1, 2""")
def footprint_bars(spark, d):
    return pf.footprint_bars(tape(spark, d), DAY_MS)


@query("stacked_imbalances", f"""{T}, {FOOT}, s AS (SELECT exchange, bar, level, 'buy' AS side FROM fp WHERE buy_imbalance UNION ALL SELECT exchange, bar, level, 'sell' FROM fp WHERE sell_imbalance),
r AS (SELECT exchange, bar, side, min(level) AS low, max(level) AS high, count(*) AS n FROM (SELECT *, level - row_number() OVER (PARTITION BY exchange, bar, side ORDER BY level) AS g FROM s) GROUP BY exchange, bar, side, g HAVING count(*) >= 3)
SELECT *, CASE WHEN side = 'buy' THEN EXISTS (SELECT 1 FROM fp WHERE fp.exchange = r.exchange AND fp.bar > r.bar AND fp.level < r.low) ELSE EXISTS (SELECT 1 FROM fp WHERE fp.exchange = r.exchange AND fp.bar > r.bar AND fp.level > r.high) END AS invalid FROM r""")
def stacked_imbalances(spark, d):
    return pf.stacked_imbalances(pf.footprint(tape(spark, d), DAY_MS, 5.0))


@query("delta_profile", f"{T}, {PROF}, p AS (SELECT exchange, list_sort(list(abs(buy - sell))) AS l FROM prof GROUP BY 1) SELECT exchange, level, buy - sell AS delta, round(least(coalesce(abs(buy - sell) / nullif(l[greatest(CAST(ceil(0.95 * len(l)) AS BIGINT), 1)], 0), 0), 1), 6) + 0.0 AS intensity FROM prof JOIN p USING (exchange)")
def delta_profile(spark, d):
    return rounded(pf.delta_profile(pf.profile(tape(spark, d), 10.0, ["exchange"]), ["exchange"]).select("exchange", "level", "delta", "intensity"), "intensity")


@query("liquidation_bands", f"""{T}, l AS (SELECT exchange, round(floor(round(price / 10, 9)) * 10, 10) AS level, sum(CASE WHEN aggressor_buy THEN qty ELSE 0 END) AS lo, sum(CASE WHEN NOT aggressor_buy THEN qty ELSE 0 END) AS sh FROM tape GROUP BY 1, 2), x AS (SELECT *, unnest([10, 25, 50, 100]) AS x FROM l),
b AS (SELECT exchange, 'long' AS side, CAST(floor(round(level * (1 - 1 / x) / 10, 9)) AS BIGINT) AS "at", lo AS q FROM x UNION ALL SELECT exchange, 'short', CAST(floor(round(level * (1 + 1 / x) / 10, 9)) AS BIGINT), sh FROM x), g AS (SELECT exchange, side, "at", sum(q) AS q FROM b GROUP BY 1, 2, 3 HAVING sum(q) > 0)
SELECT exchange, side, "at", round(q, 6) + 0.0 AS q, round(q / max(q) OVER (PARTITION BY exchange), 6) + 0.0 AS share FROM g""")
def liquidation_bands(spark, d):
    return rounded(pf.liquidation_bands(tape(spark, d), 10.0), "q share")
