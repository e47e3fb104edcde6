"""Queries of the data-quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as q
from tidemark.plans.registry import query, rounded
from tidemark.sources.schemas import DAY_MS, SHIP_SQL, TAPE_SQL, ship_tape, tape

T, S = f"WITH {TAPE_SQL}", f"WITH {SHIP_SQL}"


@query("duplicate_keys", f"{S} SELECT exchange, symbol, trade_id, count(*) AS n FROM ship GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return q.duplicates(ship_tape(spark, d), ["exchange", "symbol", "trade_id"])


@query("duplicate_summary", f"{S} SELECT exchange, count(*) AS dup_keys, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT exchange, trade_id, count(*) AS n FROM ship GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def duplicate_summary(spark, d):
    return q.duplicate_summary(ship_tape(spark, d), ["exchange", "trade_id"], ["exchange"])


@query("first_of_key", f"{S} SELECT * FROM ship QUALIFY row_number() OVER (PARTITION BY exchange, trade_id ORDER BY ts_ms, price, qty, aggressor_buy) = 1")
def first_of_key(spark, d):
    return q.first_of(ship_tape(spark, d), ["exchange", "trade_id"], ["ts_ms", "price", "qty", "aggressor_buy"])


@query("bad_values", f"{T} SELECT exchange, count(*) AS n, count(*) FILTER (price IS NULL) AS price_null, count(*) FILTER (isnan(price)) AS price_nan, count(*) FILTER (price <= 0) AS price_not_positive, count(*) FILTER (qty IS NULL) AS qty_null, count(*) FILTER (isnan(qty)) AS qty_nan, count(*) FILTER (qty <= 0) AS qty_not_positive FROM tape GROUP BY 1")
def bad_values(spark, d):
    return q.bad_values(tape(spark, d))


@query("inversions", f"{T}, x AS (SELECT exchange, ts_ms, lag(ts_ms) OVER (PARTITION BY exchange ORDER BY CAST(trade_id AS BIGINT)) AS b FROM tape) SELECT exchange, count(*) FILTER (ts_ms < b) AS inversions, max(b - ts_ms) AS worst_ms FROM x GROUP BY 1")
def inversions(spark, d):
    return q.inversions(tape(spark, d).withColumn("arrival", F.col("trade_id").cast("long")), "arrival", ["exchange"])


@query("gap_stats", f"{T}, x AS (SELECT exchange, ts_ms - lag(ts_ms) OVER (PARTITION BY exchange ORDER BY ts_ms) AS step FROM tape) SELECT exchange, count(*) FILTER (step > 600000) AS gaps, max(step) FILTER (step > 600000) AS longest, CAST(coalesce(sum(step) FILTER (step > 600000), 0) AS BIGINT) AS total, round(quantile_cont(step, 0.95), 3) + 0.0 AS p95 FROM x WHERE step IS NOT NULL GROUP BY 1")
def gap_stats(spark, d):
    return rounded(q.gap_stats(tape(spark, d), 600_000), "p95", 3)


@query("id_holes", f"{T}, x AS (SELECT DISTINCT exchange, CAST(trade_id AS BIGINT) AS id FROM tape), y AS (SELECT *, lead(id) OVER (PARTITION BY exchange ORDER BY id) AS nx FROM x) SELECT exchange, id + 1 AS first_missing, nx - 1 AS last_missing FROM y WHERE nx > id + 1")
def id_holes(spark, d):
    return q.id_holes(tape(spark, d).withColumn("id", F.col("trade_id").cast("long")), "id", ["exchange"])


@query("id_continuity", f"""{T}, g AS (SELECT exchange, ts_ms // {DAY_MS} AS day, min(CAST(trade_id AS BIGINT)) AS lo, max(CAST(trade_id AS BIGINT)) AS hi, count(DISTINCT trade_id) AS n FROM tape GROUP BY 1, 2)
SELECT *, hi - lo + 1 - n AS missing, lo - lag(hi) OVER w AS seam, day - lag(day) OVER w = 1 AS adjacent FROM g WINDOW w AS (PARTITION BY exchange ORDER BY day)""")
def id_continuity(spark, d):
    return q.id_continuity(tape(spark, d).withColumn("id", F.col("trade_id").cast("long")), "id")


@query("outside_day", f"{T} SELECT CAST(user_day AS BIGINT) AS day, count(*) AS n, count(*) FILTER (ts_ms // {DAY_MS} <> user_day) AS outside FROM (SELECT *, (ts_ms + 3600000) // {DAY_MS} AS user_day FROM tape) GROUP BY 1")
def outside_day(spark, d):
    return q.outside_day(tape(spark, d), F.floor((F.col("ts_ms") + 3_600_000) / DAY_MS).cast("long"))


COVER = "x AS (SELECT exchange, ts_ms // 3600000 AS hour, least(coalesce(lead(ts_ms) OVER (PARTITION BY exchange ORDER BY ts_ms), ts_ms + 600000) - ts_ms, 600000) AS ms FROM tape), hc AS (SELECT exchange, hour, sum(ms) / 3600000 AS covered FROM x GROUP BY 1, 2), hs AS (SELECT *, CASE WHEN covered >= 0.9 THEN 'on' WHEN covered < 0.1 THEN 'off' ELSE 'partial' END AS state FROM hc)"


@query("hourly_coverage", f"{T}, {COVER} SELECT exchange, hour, round(covered, 6) + 0.0 AS covered, state FROM hs")
def hourly_coverage(spark, d):
    return rounded(q.hourly_coverage(tape(spark, d), 600_000), "covered")


@query("coverage_census", f"""{T}, {COVER}, g AS (SELECT exchange, hour FROM (SELECT DISTINCT exchange FROM tape), (SELECT unnest(range(19723 * 24, 19753 * 24)) AS hour))
SELECT g.exchange, g.hour // 24 AS day, count(*) FILTER (coalesce(state, 'off') = 'on') AS "on", count(*) FILTER (coalesce(state, 'off') = 'partial') AS partial, count(*) FILTER (coalesce(state, 'off') = 'off') AS off FROM g LEFT JOIN hs ON g.exchange = hs.exchange AND g.hour = hs.hour GROUP BY 1, 2""")
def coverage_census(spark, d):
    return q.census(tape(spark, d), 600_000, 19_723, 30)


@query("inventory", f"{T} SELECT exchange, count(*) AS n, count(DISTINCT symbol) AS symbols, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, round(count(*) * 60000.0 / (max(ts_ms) - min(ts_ms)), 6) + 0.0 AS per_minute FROM tape GROUP BY 1")
def inventory(spark, d):
    return rounded(q.inventory(tape(spark, d)), "per_minute")


@query("several_symbols", f"{T} SELECT exchange, count(DISTINCT trade_id[1:1]) AS symbols FROM tape GROUP BY 1 HAVING count(DISTINCT trade_id[1:1]) > 1")
def several_symbols(spark, d):
    return q.several_symbols(tape(spark, d).withColumn("symbol", F.substring("trade_id", 1, 1)))


@query("manifest", f'{T} SELECT ts_ms // {DAY_MS} AS day, count(*) AS "rows", min(ts_ms) AS ts_min, max(ts_ms) AS ts_max FROM tape GROUP BY 1')
def manifest(spark, d):
    return q.manifest(tape(spark, d))


@query("manifest_diff", f"""{T}, a AS (SELECT ts_ms // {DAY_MS} AS day, count(*) AS "rows", min(ts_ms) AS ts_min, max(ts_ms) AS ts_max FROM tape GROUP BY 1), b AS (SELECT ts_ms // {DAY_MS} AS day, count(*) AS "rows", min(ts_ms) AS ts_min, max(ts_ms) AS ts_max FROM tape WHERE exchange <> 'error' GROUP BY 1)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def manifest_diff(spark, d):
    t = tape(spark, d)
    return q.manifest_diff(q.manifest(t), q.manifest(t.filter("exchange <> 'error'")))


@query("table_diff", f"""{T}, a AS (SELECT * FROM tape WHERE qty > 5), b AS (SELECT trade_id, CASE WHEN qty > 90 THEN price + 1 ELSE price END AS price, qty FROM tape WHERE qty < 95)
SELECT count(*) FILTER (b.trade_id IS NULL) AS only_a, count(*) FILTER (a.trade_id IS NULL) AS only_b, count(*) FILTER (a.trade_id IS NOT NULL AND b.trade_id IS NOT NULL) AS "both", count(*) FILTER (a.trade_id IS NOT NULL AND b.trade_id IS NOT NULL AND a.price IS DISTINCT FROM b.price) AS diff_price, count(*) FILTER (a.trade_id IS NOT NULL AND b.trade_id IS NOT NULL AND a.qty IS DISTINCT FROM b.qty) AS diff_qty FROM a FULL JOIN b ON a.trade_id = b.trade_id""")
def table_diff(spark, d):
    t = tape(spark, d)
    b = t.filter("qty < 95").withColumn("price", F.when(F.col("qty") > 90, F.col("price") + 1).otherwise(F.col("price")))
    return q.table_diff(t.filter("qty > 5"), b, "trade_id", ["price", "qty"])


BURST = "x AS (SELECT exchange, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER w > 300000 THEN 1 ELSE 0 END AS f FROM tape WINDOW w AS (PARTITION BY exchange ORDER BY ts_ms)), y AS (SELECT *, CAST(sum(f) OVER (PARTITION BY exchange ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM x), bu AS (SELECT exchange, session, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n FROM y GROUP BY 1, 2)"


@query("bursts", f"{T}, {BURST} SELECT * FROM bu")
def bursts(spark, d):
    return q.bursts(tape(spark, d), 300_000, ["exchange"])


@query("quiet_periods", f"{T}, {BURST} SELECT * FROM (SELECT exchange, session, round((lead(first_ms) OVER (PARTITION BY exchange ORDER BY session) - last_ms) / 3600000, 6) + 0.0 AS quiet_h FROM bu) WHERE quiet_h IS NOT NULL")
def quiet_periods(spark, d):
    return rounded(q.quiet_periods(q.bursts(tape(spark, d), 300_000, ["exchange"]), ["exchange"]), "quiet_h")


@query("overlapping_extent", f"""{T}, w AS (SELECT exchange AS name, min(ts_ms) AS lo, max(ts_ms) AS hi FROM tape GROUP BY exchange, ts_ms // (5 * {DAY_MS})), a AS (SELECT exchange AS name, min(ts_ms) AS a_lo, max(ts_ms) AS a_hi FROM tape GROUP BY exchange, ts_ms // (7 * {DAY_MS}))
SELECT w.name, lo, hi, arg_min(a_lo, a_lo) AS a_lo, arg_min(a_hi, a_lo) AS a_hi FROM w JOIN a ON w.name = a.name AND a_lo <= hi AND lo <= a_hi GROUP BY 1, 2, 3""")
def overlapping_extent(spark, d):
    t = tape(spark, d)
    ext = lambda days, lo, hi: t.groupBy(F.col("exchange").alias("name"), F.floor(F.col("ts_ms") / (days * DAY_MS)).alias("p")).agg(F.min("ts_ms").alias(lo), F.max("ts_ms").alias(hi)).drop("p")
    return q.overlapping_extent(ext(7, "a_lo", "a_hi"), ext(5, "lo", "hi"))


@query("minute_coherence", f"""{T}, m AS (SELECT exchange, ts_ms // 3600000 AS minute, avg(price) AS p FROM tape WHERE exchange IN ('click', 'view') GROUP BY 1, 2), u AS (SELECT *, sign(p - lag(p) OVER (PARTITION BY exchange ORDER BY minute)) AS up FROM m),
j AS (SELECT abs((a.p - b.p) / b.p) * 10000 AS bp, a.up = b.up AS same FROM u a JOIN u b ON a.minute = b.minute AND a.exchange = 'click' AND b.exchange = 'view')
SELECT count(*) AS minutes, round(quantile_cont(bp, 0.5), 6) + 0.0 AS p50, round(quantile_cont(bp, 0.95), 6) + 0.0 AS p95, round(avg(CAST(same AS DOUBLE)), 6) + 0.0 AS agree FROM j""")
def minute_coherence(spark, d):
    return rounded(q.minute_coherence(tape(spark, d), "click", "view", 3_600_000), "p50 p95 agree")
