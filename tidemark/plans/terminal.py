"""Queries of the terminal's operators over the tape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import bars, books, profiles, terminal as tm
from tidemark.plans.profiles import FOOT
from tidemark.plans.registry import query, rounded
from tidemark.sources.schemas import DAY_MS, TAPE_SQL, book, book_sql, read, tape

T = f"WITH {TAPE_SQL}"
VALID = "v AS (SELECT *, price * qty AS notional FROM tape WHERE price > 0 AND qty > 0)"


@query("tape_rows", f"{T}, {VALID} SELECT trade_id, round(notional, 6) + 0.0 AS notional, CASE WHEN notional <= 10000 THEN 0 WHEN notional <= 100000 THEN 1 WHEN notional <= 1000000 THEN 2 ELSE 3 END AS tier FROM v WHERE notional >= 2000 AND exchange IN ('click', 'view')")
def tape_rows(spark, d):
    return rounded(tm.tape_rows(tape(spark, d), ["click", "view"], 2000.0).select("trade_id", "notional", "tier"), "notional")


@query("tape_floor", f"{T}, {VALID} SELECT exchange, count(*) FILTER (notional < 2000) AS prints, round(sum(CASE WHEN notional < 2000 AND aggressor_buy THEN notional ELSE 0 END), 4) + 0.0 AS buy, round(sum(CASE WHEN notional < 2000 AND NOT aggressor_buy THEN notional ELSE 0 END), 4) + 0.0 AS sell, round(sum(CASE WHEN notional < 2000 THEN notional ELSE 0 END) / sum(notional), 6) + 0.0 AS share FROM v GROUP BY 1")
def tape_floor(spark, d):
    return rounded(rounded(tm.tape_floor(tape(spark, d), 2000.0), "buy sell", 4), "share")


@query("news_relevance", f"""WITH n AS (SELECT doc_id, lower(text) AS t, lower(source) AS s FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, '{tm.COINS.replace("(", "(?:")}') THEN 'coin' WHEN regexp_matches(s, '{tm.PRESS.replace("(", "(?:")}') THEN 'press' WHEN regexp_matches(t, '{tm.KEYWORDS.replace("(", "(?:")}') THEN 'keyword' WHEN regexp_matches(t, '{tm.VENUES.replace("(", "(?:")}') THEN 'venue' END AS why FROM n""")
def news_relevance(spark, d):
    items = read(spark, d, "documents").select("doc_id", F.col("text").alias("title"), "source", F.array().cast("array<string>").alias("symbols"))
    return tm.news_relevance(items).select("doc_id", "why")


@query("news_counts", f"""WITH n AS (SELECT lower(text) AS t, lower(source) AS s FROM documents), k AS (SELECT *, regexp_matches(t, '{tm.COINS.replace("(", "(?:")}') OR regexp_matches(s, '{tm.PRESS.replace("(", "(?:")}') OR regexp_matches(t, '{tm.KEYWORDS.replace("(", "(?:")}') OR regexp_matches(t, '{tm.VENUES.replace("(", "(?:")}') AS hit FROM n)
SELECT count(*) AS total, count(*) FILTER (hit) AS kept, count(*) FILTER (NOT coalesce(hit, false)) AS filtered, count(*) FILTER (regexp_matches(t, '\\b(?:bitcoin|btc)\\b')) AS btc FROM k""")
def news_counts(spark, d):
    return tm.news_counts(read(spark, d, "documents").select(F.col("text").alias("title"), "source", F.array().cast("array<string>").alias("symbols")))


JOURNAL = "jn AS (SELECT trade_id, ts_ms, exchange AS tag, CASE WHEN qty <> 0 THEN round((price - 50) / 25, 4) END AS r FROM tape)"


def _journal(spark, d):
    return tape(spark, d).select("trade_id", "ts_ms", F.col("exchange").alias("tag"), F.when(F.col("qty") != 0, F.round((F.col("price") - 50) / 25, 4)).alias("r"))


@query("journal_stats", f"""{T}, {JOURNAL}, c AS (SELECT *, sum(coalesce(r, 0)) OVER (PARTITION BY tag ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS c FROM jn), x AS (SELECT *, c - greatest(max(c) OVER (PARTITION BY tag ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING), 0) AS dd FROM c)
SELECT tag, count(r) AS n, count(*) FILTER (r IS NULL) AS excluded, round(avg(CAST(r > 0 AS DOUBLE)), 6) + 0.0 AS win_rate, round(avg(r), 6) + 0.0 AS expectancy, round(avg(r) / stddev_samp(r) * sqrt(count(r)), 6) + 0.0 AS sqn, round(sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r < 0)), 6) + 0.0 AS profit_factor, round(min(dd), 6) + 0.0 AS max_drawdown FROM x GROUP BY 1""")
def journal_stats(spark, d):
    return rounded(tm.journal_stats(_journal(spark, d), ["tag"]).drop("avg_win", "avg_loss"), "win_rate expectancy sqn profit_factor max_drawdown")


@query("calendar_returns", f"""{T}, {JOURNAL}, k AS (SELECT r, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, strftime(make_timestamp(ts_ms * 1000), '%G-W%V') AS week, strftime(make_timestamp(ts_ms * 1000), '%Y-%m') AS month, strftime(make_timestamp(ts_ms * 1000), '%H') AS hour FROM jn)
SELECT CASE WHEN day IS NOT NULL THEN 'day' WHEN week IS NOT NULL THEN 'week' WHEN month IS NOT NULL THEN 'month' ELSE 'hour' END AS kind, coalesce(day, week, month, hour) AS key, round(sum(r), 6) + 0.0 AS r, count(r) AS n FROM k GROUP BY GROUPING SETS ((day), (week), (month), (hour))""")
def calendar_returns(spark, d):
    return rounded(tm.calendar_returns(_journal(spark, d)), "r")


@query("screener", "SELECT p_name || p_partkey AS symbol, CASE WHEN p_size > 5 THEN p_retailprice * p_size END AS turnover FROM part ORDER BY turnover DESC NULLS LAST, symbol LIMIT 25")
def screener(spark, d):
    p = read(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("symbol"), F.when(F.col("p_size") > 5, F.col("p_retailprice") * F.col("p_size")).alias("turnover"))
    return tm.screener(p, 25)


@query("cvd", f"{T}, x AS (SELECT exchange, ts_ms, trade_id, CASE WHEN aggressor_buy THEN 1 ELSE -1 END * price * qty AS x, price * qty <= 10000 AS s FROM tape) SELECT exchange, trade_id, round(sum(x) OVER w, 4) + 0.0 AS cvd, round(sum(CASE WHEN s THEN x ELSE 0 END) OVER w, 4) + 0.0 AS cvd_0 FROM x WINDOW w AS (PARTITION BY exchange ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING)")
def cvd(spark, d):
    return rounded(tm.cvd(tape(spark, d)).select("exchange", "trade_id", "cvd", "cvd_0"), "cvd cvd_0", 4)


@query("tape_intensity", f"""{T}, b AS (SELECT exchange, ts_ms // 600000 AS bucket, count(*) AS n FROM tape GROUP BY 1, 2), p AS (SELECT exchange, bucket, avg(n) OVER w AS m, stddev_samp(n) OVER w AS s FROM b WINDOW w AS (PARTITION BY exchange ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT exchange, trade_id, ts_ms // 600000 AS bucket, count(*) OVER a AS na, count(*) OVER c AS nc, sum(price * qty) OVER c AS vc FROM tape WINDOW a AS (PARTITION BY exchange ORDER BY ts_ms RANGE 599999 PRECEDING), c AS (PARTITION BY exchange ORDER BY ts_ms RANGE 3599999 PRECEDING))
SELECT x.exchange, trade_id, round(na / 600.0, 6) + 0.0 AS rate_short, round(nc / 3600.0, 6) + 0.0 AS rate_long, round(vc / 3600.0, 6) + 0.0 AS notional_long, round(CASE WHEN s <> 0 THEN (na - m) / s END, 6) + 0.0 AS z FROM x JOIN p ON x.exchange = p.exchange AND x.bucket = p.bucket""")
def tape_intensity(spark, d):
    return rounded(tm.intensity(tape(spark, d), 600_000, 3_600_000).select("exchange", "trade_id", "rate_short", "rate_long", "notional_long", "z"), "rate_short rate_long notional_long z")


@query("trailing_by_level", f"{T}, x AS (SELECT *, CAST(floor(round(price / 10, 9)) AS BIGINT) AS level FROM tape) SELECT trade_id, level, sum(CASE WHEN aggressor_buy THEN qty ELSE 0 END) OVER w AS buy, sum(CASE WHEN NOT aggressor_buy THEN qty ELSE 0 END) OVER w AS sell FROM x WINDOW w AS (PARTITION BY exchange, level ORDER BY ts_ms RANGE 3599999 PRECEDING)")
def trailing_by_level(spark, d):
    return tm.trailing_by_level(tape(spark, d), 3_600_000, 10.0).select("trade_id", "level", "buy", "sell")


@query("trailing_liquidations", f"{T} SELECT trade_id, round(sum(price * qty) OVER (PARTITION BY exchange ORDER BY ts_ms RANGE 299999 PRECEDING), 4) + 0.0 AS last_5m FROM tape WHERE qty > 20")
def trailing_liquidations(spark, d):
    forced = tape(spark, d).filter("qty > 20").withColumn("notional_usd", F.col("price") * F.col("qty"))
    return rounded(tm.trailing_sum(forced, "notional_usd", 300_000, "last_5m").select("trade_id", "last_5m"), "last_5m", 4)


@query("leg_cvd", f"""{T}, b AS (SELECT ts_ms // 600000 * 600000 AS ts_ms, sum(CASE WHEN exchange IN ('click', 'view') THEN x ELSE 0 END) AS p, sum(CASE WHEN exchange IN ('click', 'view') THEN 0 ELSE x END) AS s FROM (SELECT *, CASE WHEN aggressor_buy THEN 1 ELSE -1 END * price * qty AS x FROM tape) WHERE x <> 0 GROUP BY 1)
SELECT ts_ms, round(sum(p) OVER (ORDER BY ts_ms), 4) + 0.0 AS cvd_perp, round(sum(s) OVER (ORDER BY ts_ms), 4) + 0.0 AS cvd_spot FROM b QUALIFY ts_ms < max(ts_ms) OVER ()""")
def leg_cvd(spark, d):
    return rounded(tm.leg_cvd(tape(spark, d), ["click", "view"], 600_000), "cvd_perp cvd_spot", 4)


@query("log_bar_width", f"{T} SELECT trade_id, round(greatest(0, least(1, ln(1 + qty) / ln(1 + 50))), 6) + 0.0 AS width FROM tape")
def log_bar_width(spark, d):
    return rounded(tape(spark, d).select("trade_id", scalars.log_bar_width(F.col("qty"), F.lit(50.0)).alias("width")), "width")


@query("last_prints", f"{T} SELECT trade_id, ts_ms, price FROM tape WHERE price * qty >= 5000 ORDER BY ts_ms DESC, trade_id DESC LIMIT 12")
def last_prints(spark, d):
    return tm.last_prints(tape(spark, d), 12, 5000.0).select("trade_id", "ts_ms", "price")


@query("bounded_select", f"{T} SELECT trade_id, ts_ms, price, qty FROM tape WHERE exchange IN ('click', 'view') AND ts_ms BETWEEN 1704153600000 AND 1704240000000 ORDER BY ts_ms, trade_id LIMIT 1000")
def bounded_select(spark, d):
    return tape(spark, d).filter(F.col("exchange").isin("click", "view") & F.col("ts_ms").between(1_704_153_600_000, 1_704_240_000_000)).select("trade_id", "ts_ms", "price", "qty").orderBy("ts_ms", "trade_id").limit(1000)


@query("trade_circles", f"{T}, r AS (SELECT exchange, price * qty AS v, row_number() OVER (PARTITION BY exchange ORDER BY price * qty) AS i, count(*) OVER (PARTITION BY exchange) AS n FROM tape), p AS (SELECT exchange, v AS p95 FROM r WHERE i = ceil(0.95 * n)) SELECT trade_id, round(least(sqrt(price * qty / p95), 3), 6) + 0.0 AS size FROM tape JOIN p USING (exchange)")
def trade_circles(spark, d):
    return rounded(tm.trade_circles(tape(spark, d)).select("trade_id", "size"), "size")


@query("opening_type", f"""{T}, b AS (SELECT exchange, ts_ms // 3600000 AS bar, ts_ms // {DAY_MS} AS day, first(price ORDER BY ts_ms, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_ms, trade_id) AS close FROM tape GROUP BY 1, 2, 3),
i AS (SELECT *, row_number() OVER w AS i, first(open) OVER w AS o FROM b WINDOW w AS (PARTITION BY exchange, day ORDER BY bar)), s AS (SELECT *, sign(close - o) AS s FROM i WHERE i <= 6),
x AS (SELECT *, s * lag(s) OVER (PARTITION BY exchange, day ORDER BY bar) < 0 AS x FROM s),
g AS (SELECT exchange, day, count(*) AS n, count(*) FILTER (x) AS c, last(s ORDER BY bar) AS l, max(high) - first(o) AS up, first(o) - min(low) AS down FROM x GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN l > 0 THEN down ELSE up END AS against, CASE WHEN l > 0 THEN up ELSE down END AS along FROM g)
SELECT exchange, day, n, CASE WHEN n < 6 THEN 'pending' WHEN c = 0 AND against <= 0.1 * along THEN 'drive' WHEN c <= 1 AND against <= 0.5 * along THEN 'test_drive' WHEN c <= 1 THEN 'rejection_reverse' ELSE 'auction' END AS kind FROM a""")
def opening_type(spark, d):
    b = bars.trade_bars(tape(spark, d), 3_600_000).withColumn("day", F.floor(F.col("bar") / 24).cast("long"))
    return tm.opening_type(b, 6)


@query("absorption", f"""{T}, {FOOT}, b AS (SELECT exchange, ts_ms // {DAY_MS} AS bar, max(price) AS high, min(price) AS low FROM tape GROUP BY 1, 2), n AS (SELECT exchange, bar, lead(high) OVER w <= high AS nh, lead(low) OVER w >= low AS nl FROM b WINDOW w AS (PARTITION BY exchange ORDER BY bar)),
m AS (SELECT exchange, bar, median(buy + sell) AS m FROM fp GROUP BY 1, 2) SELECT fp.exchange, fp.bar, level, CASE WHEN buy >= sell THEN 'buy' ELSE 'sell' END AS side, buy + sell AS volume FROM fp JOIN m ON fp.exchange = m.exchange AND fp.bar = m.bar JOIN n ON fp.exchange = n.exchange AND fp.bar = n.bar WHERE buy + sell >= 3 * m AND CASE WHEN buy >= sell THEN nh ELSE nl END""")
def absorption(spark, d):
    t = tape(spark, d)
    return tm.absorption(profiles.footprint(t, DAY_MS, 5.0), bars.trade_bars(t, DAY_MS).select("exchange", "bar", "high", "low"))


@query("downsample", f"""WITH RECURSIVE {TAPE_SQL}, k AS (SELECT exchange, min(ts_ms) AS ts_ms FROM tape GROUP BY 1 UNION ALL SELECT k.exchange, (SELECT min(t.ts_ms) FROM tape t WHERE t.exchange = k.exchange AND t.ts_ms >= k.ts_ms + 21600000) FROM k WHERE k.ts_ms IS NOT NULL)
SELECT exchange, ts_ms FROM k WHERE ts_ms IS NOT NULL""")
def downsample(spark, d):
    return tm.downsample(tape(spark, d), 21_600_000).select("exchange", "ts_ms")


@query("print_blocks", f"""WITH RECURSIVE {TAPE_SQL}, t AS (SELECT exchange, ts_ms, trade_id, floor(price / 20) * 20.0 AS price, qty, aggressor_buy FROM tape),
f AS (SELECT *, CASE WHEN lag(price) OVER w IS DISTINCT FROM price OR lag(aggressor_buy) OVER w IS DISTINCT FROM aggressor_buy THEN 1 ELSE 0 END AS f FROM t WINDOW w AS (PARTITION BY exchange ORDER BY ts_ms, trade_id)),
r AS (SELECT *, sum(f) OVER (PARTITION BY exchange ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
k AS (SELECT exchange, run, min(ts_ms) AS s FROM r GROUP BY 1, 2 UNION ALL SELECT k.exchange, k.run, (SELECT min(r.ts_ms) FROM r WHERE r.exchange = k.exchange AND r.run = k.run AND r.ts_ms > k.s + 3600000) FROM k WHERE k.s IS NOT NULL)
SELECT r.exchange, k.s AS ts_ms, r.price, r.aggressor_buy, round(sum(r.qty), 6) + 0.0 AS qty, count(*) AS prints FROM r JOIN k ON r.exchange = k.exchange AND r.run = k.run AND k.s <= r.ts_ms AND r.ts_ms <= k.s + 3600000 GROUP BY 1, r.run, 2, 3, 4""")
def print_blocks(spark, d):
    t = tape(spark, d).withColumn("price", F.floor(F.col("price") / 20) * 20.0)
    return rounded(tm.blocks(t, 3_600_000), "qty")


@query("volume_clock", f"""{T}, a AS (SELECT *, sum(qty) OVER (PARTITION BY exchange ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS c1 FROM tape WHERE qty > 0), b AS (SELECT *, c1 - qty AS c0, unnest(range(CAST(floor((c1 - qty) / 1000) AS BIGINT), CAST(ceil(c1 / 1000) AS BIGINT))) AS k FROM a),
c AS (SELECT *, least(c1, (k + 1) * 1000) - greatest(c0, k * 1000) AS part FROM b) SELECT exchange, k, max(ts_ms) AS close_ms, round(abs(sum(CASE WHEN aggressor_buy THEN part ELSE -part END)) / 1000, 6) + 0.0 AS imbalance FROM c WHERE part > 0 GROUP BY 1, 2 HAVING sum(part) >= 1000 * (1 - 1e-9)""")
def volume_clock(spark, d):
    return rounded(tm.volume_clock(tape(spark, d), 1000.0), "imbalance")


@query("alerts", f"""WITH RECURSIVE {TAPE_SQL}, h AS (SELECT exchange, ts_ms, price FROM (SELECT *, lag(price) OVER (PARTITION BY exchange ORDER BY ts_ms, trade_id) AS b FROM tape) WHERE b <= 80 AND price > 80), k AS (SELECT exchange, min(ts_ms) AS ts_ms FROM h GROUP BY 1 UNION ALL SELECT k.exchange, (SELECT min(h.ts_ms) FROM h WHERE h.exchange = k.exchange AND h.ts_ms >= k.ts_ms + 3600000) FROM k WHERE k.ts_ms IS NOT NULL)
SELECT k.exchange, k.ts_ms, h.price FROM k JOIN h ON k.exchange = h.exchange AND k.ts_ms = h.ts_ms""")
def alerts(spark, d):
    return tm.alerts(tape(spark, d), "cross_up", 80.0, 3_600_000)


@query("sampled_corr", f"""{T}, s AS (SELECT exchange, ts_ms // {DAY_MS} AS k, last(price ORDER BY ts_ms, trade_id) AS p FROM tape GROUP BY 1, 2), r AS (SELECT exchange, k, CASE WHEN lag(k) OVER w = k - 1 AND p > 0 AND lag(p) OVER w > 0 THEN ln(p / lag(p) OVER w) END AS r FROM s WINDOW w AS (PARTITION BY exchange ORDER BY k))
SELECT a.exchange AS a, b.exchange AS b, count(*) AS n, round(corr(a.r, b.r), 6) + 0.0 AS r FROM r a JOIN r b ON a.k = b.k AND a.exchange < b.exchange WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2""")
def sampled_corr(spark, d):
    return rounded(tm.sampled_corr(tape(spark, d), DAY_MS), "r")


LEVELS = "lv AS (SELECT exchange, ts_ms, 'bid' AS side, x[1] AS price, x[2] AS qty FROM (SELECT exchange, ts_ms, unnest(bids) AS x FROM book) UNION ALL SELECT exchange, ts_ms, 'ask', x[1], x[2] FROM (SELECT exchange, ts_ms, unnest(asks) AS x FROM book))"


@query("walls", f"""WITH {book_sql()}, {LEVELS}, sn AS (SELECT exchange, ts_ms, row_number() OVER (PARTITION BY exchange ORDER BY ts_ms) AS no FROM (SELECT DISTINCT exchange, ts_ms FROM lv)),
rk AS (SELECT exchange, ts_ms, qty, row_number() OVER (PARTITION BY exchange, ts_ms ORDER BY qty) AS i, count(*) OVER (PARTITION BY exchange, ts_ms) AS n FROM lv), pc AS (SELECT exchange, ts_ms, qty AS p95 FROM rk WHERE i = greatest(ceil(0.95 * n), 1)),
big AS (SELECT lv.*, no, no - row_number() OVER (PARTITION BY lv.exchange, side, price ORDER BY no) AS g FROM lv JOIN pc ON lv.exchange = pc.exchange AND lv.ts_ms = pc.ts_ms AND qty >= 0.6 * p95 JOIN sn ON lv.exchange = sn.exchange AND lv.ts_ms = sn.ts_ms)
SELECT exchange, side, price, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n, max(qty) AS qty, CASE WHEN max(no) = (SELECT max(no) FROM sn WHERE sn.exchange = big.exchange) THEN 'standing' ELSE 'gone' END AS state FROM big GROUP BY exchange, side, price, g HAVING count(*) >= 2""")
def walls(spark, d):
    f = books.parsed(book(spark, d)).select("exchange", "ts_ms", F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.col("bids").alias("l")), F.struct(F.lit("ask").alias("side"), F.col("asks").alias("l")))).alias("s")).select("exchange", "ts_ms", "s.side", F.explode("s.l").alias("x"))
    return tm.walls(f.select("exchange", "ts_ms", "side", F.col("x")[0].alias("price"), F.col("x")[1].alias("qty")), 0.6, 2)


@query("confluence", f"{T}, b AS (SELECT exchange, ts_ms // {DAY_MS} AS bar, avg(price) AS p, sum(qty) AS q FROM tape GROUP BY 1, 2) SELECT exchange, bar, CAST(p >= 55 AS INTEGER) + CAST(q >= 600 AS INTEGER) AS bull, CAST(p <= 45 AS INTEGER) + CAST(q <= 300 AS INTEGER) AS bear FROM b")
def confluence(spark, d):
    b = tape(spark, d).groupBy("exchange", bars.bar_of("ts_ms", DAY_MS).alias("bar")).agg(F.avg("price").alias("p"), F.sum("qty").alias("q"))
    return tm.confluence(b, {"p": (45.0, 55.0), "q": (300.0, 600.0)}).select("exchange", "bar", "bull", "bear")
