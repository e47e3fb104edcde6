"""Queries over the event tape and the books."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, bars, books
from tidemark.plans.registry import query, rounded, sql_rounded
from tidemark.sources.schemas import DAY_MS, SHIP_SQL, TAPE_SQL, book, book_sql, ship_tape, tape

HOUR = 3_600_000
START, END = 1_704_067_200_000, 1_704_067_200_000 + 30 * DAY_MS  # 2024-01-01, thirty days
GAP = HOUR  # silence that counts as a hole: long enough that the sparse test tape has covered bars, holes and several segments

OHLC = "open high low close"
TIERED = "delta_small delta_medium delta_large delta_whale"
BARS_SQL = f"""trade_bars AS (SELECT exchange, ts_ms // {HOUR} AS bar, first(price ORDER BY ts_ms, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_ms, trade_id) AS close,
    sum(qty) AS volume, count(*) AS n, sum(CASE WHEN aggressor_buy THEN qty ELSE 0 END) AS buy, sum(CASE WHEN NOT aggressor_buy THEN qty ELSE 0 END) AS sell, sum(price * qty) AS notional,
    sum(CASE WHEN price * qty <= 10000 THEN s * price * qty ELSE 0 END) AS delta_small, sum(CASE WHEN price * qty > 10000 AND price * qty <= 100000 THEN s * price * qty ELSE 0 END) AS delta_medium,
    sum(CASE WHEN price * qty > 100000 AND price * qty <= 1000000 THEN s * price * qty ELSE 0 END) AS delta_large, sum(CASE WHEN price * qty > 1000000 THEN s * price * qty ELSE 0 END) AS delta_whale
    FROM (SELECT *, CASE WHEN aggressor_buy THEN 1.0 ELSE -1.0 END AS s FROM tape) GROUP BY 1, 2)"""
SUMS = f"volume buy sell notional {TIERED}"


@query("trade_bars", f"WITH {TAPE_SQL}, {BARS_SQL} SELECT exchange, bar, open, high, low, close, n, {sql_rounded(SUMS)} FROM trade_bars")
def trade_bars(spark, d):
    return rounded(bars.trade_bars(tape(spark, d), HOUR), SUMS)


@query("ship_bars", f"""WITH {SHIP_SQL} SELECT exchange, ts_ms // {DAY_MS} AS bar, max(price) AS high, min(price) AS low, count(*) AS n, {sql_rounded("sum(qty)").replace("AS sum(qty)", "AS volume")}, round(sum(price * qty), 2) + 0.0 AS notional FROM ship GROUP BY 1, 2""")
def ship_bars(spark, d):
    out = bars.trade_bars(ship_tape(spark, d), DAY_MS).select("exchange", "bar", "high", "low", "n", "volume", "notional")
    return rounded(rounded(out, "volume"), "notional", 2)


@query("liquidation_bars", f"""WITH {TAPE_SQL}, liq AS (SELECT exchange, ts_ms, CASE WHEN aggressor_buy THEN 'Short' ELSE 'LONG' END AS side, price * qty AS v FROM tape WHERE exchange = 'error')
SELECT exchange, ts_ms // {DAY_MS} AS bar, count(*) AS liq_n, round(sum(v), 6) + 0.0 AS liq_notional, round(coalesce(sum(v) FILTER (lower(side) = 'long'), 0), 6) + 0.0 AS liq_long, round(coalesce(sum(v) FILTER (lower(side) = 'short'), 0), 6) + 0.0 AS liq_short FROM liq GROUP BY 1, 2""")
def liquidation_bars(spark, d):
    t = tape(spark, d).filter("exchange = 'error'").withColumns({"side": F.when(F.col("aggressor_buy"), "Short").otherwise("LONG"), "notional_usd": F.col("price") * F.col("qty")})
    return rounded(bars.liquidation_bars(t, DAY_MS), "liq_notional liq_long liq_short")


HOLES_SQL = f"""seen AS (SELECT DISTINCT exchange, ts_ms FROM tape WHERE ts_ms >= {START} AND ts_ms < {END}),
holes AS (SELECT * FROM (SELECT exchange, coalesce(lag(ts_ms) OVER (PARTITION BY exchange ORDER BY ts_ms), {START}) AS h0, ts_ms AS h1 FROM seen UNION ALL SELECT exchange, max(ts_ms), {END} FROM seen GROUP BY 1) WHERE h1 - h0 > {GAP})"""


@query("tape_holes", f"WITH {TAPE_SQL}, {HOLES_SQL} SELECT exchange, h0, h1 FROM holes")
def tape_holes(spark, d):
    return bars.holes(tape(spark, d), START, END, GAP)


GAPS_SQL = f"""gaps AS (SELECT exchange, bar, least(sum(least(h1, (bar + 1) * {HOUR}) - greatest(h0, bar * {HOUR})), {HOUR})::BIGINT AS gap_ms FROM (SELECT exchange, h0, h1, unnest(range(h0 // {HOUR}, (h1 - 1) // {HOUR} + 1)) AS bar FROM holes) GROUP BY 1, 2)"""


@query("gap_by_bar", f"WITH {TAPE_SQL}, {HOLES_SQL}, {GAPS_SQL} SELECT * FROM gaps")
def gap_by_bar(spark, d):
    return bars.gap_by_bar(bars.holes(tape(spark, d), START, END, GAP), HOUR)


COVERED_SQL = f"""grid AS (SELECT exchange, bar FROM (SELECT DISTINCT exchange FROM tape), (SELECT unnest(range({START // HOUR}, {END // HOUR})) AS bar)),
c0 AS (SELECT g.exchange, g.bar, t.open, t.close, t.volume, t.buy, t.sell, t.notional, t.n, p.gap_ms, 1 - coalesce(p.gap_ms, 0) / {HOUR}.0 AS coverage FROM grid g LEFT JOIN trade_bars t ON g.exchange = t.exchange AND g.bar = t.bar LEFT JOIN gaps p ON g.exchange = p.exchange AND g.bar = p.bar),
c1 AS (SELECT * EXCLUDE (volume, buy, sell, n), CASE WHEN volume IS NULL AND coverage > 0 THEN 0 ELSE volume END AS volume, CASE WHEN buy IS NULL AND coverage > 0 THEN 0 ELSE buy END AS buy, CASE WHEN sell IS NULL AND coverage > 0 THEN 0 ELSE sell END AS sell, CASE WHEN n IS NULL AND coverage > 0 THEN 0 ELSE n END AS n,
    CASE WHEN coverage >= 1 AND coalesce(lag(coverage >= 1) OVER (PARTITION BY exchange ORDER BY bar), false) THEN 0 ELSE 1 END AS fresh FROM c0),
c2 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY exchange ORDER BY bar ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment, buy - sell AS delta FROM c1),
covered AS (SELECT *, CASE WHEN delta IS NOT NULL THEN sum(coalesce(delta, 0)) OVER (PARTITION BY exchange, segment ORDER BY bar ROWS UNBOUNDED PRECEDING) END AS cvd,
    coverage < 1 OR coalesce(lag(coverage) OVER w < 1, true) OR close IS NULL OR lag(close) OVER w IS NULL AS ret_spans_gap, CASE WHEN volume <> 0 THEN notional / volume END AS vwap FROM c2 WINDOW w AS (PARTITION BY exchange ORDER BY bar))"""
ALL_COVERED = f"WITH {TAPE_SQL}, {BARS_SQL}, {HOLES_SQL}, {GAPS_SQL}, {COVERED_SQL}"


def _covered(spark, d):
    return bars.covered_bars(tape(spark, d), START, END, HOUR, GAP)


@query("covered_bars", f"{ALL_COVERED} SELECT exchange, bar, n, segment, ret_spans_gap, {sql_rounded('coverage volume delta cvd vwap')} FROM covered")
def covered_bars(spark, d):
    return rounded(_covered(spark, d).select("exchange", "bar", F.col("n").cast("long").alias("n"), "segment", "ret_spans_gap", "coverage", "volume", "delta", "cvd", "vwap"), "coverage volume delta cvd vwap")


@query("drop_gap_bars", f"{ALL_COVERED} SELECT exchange, bar, open, close FROM covered WHERE coverage >= 0.5 AND NOT ret_spans_gap")
def drop_gap_bars(spark, d):
    return bars.drop_gap_bars(_covered(spark, d), 0.5).select("exchange", "bar", "open", "close")


@query("gap_flat_positions", f"{ALL_COVERED} SELECT exchange, bar, CASE WHEN coalesce(lead(ret_spans_gap) OVER (PARTITION BY exchange ORDER BY bar), true) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS position FROM covered")
def gap_flat_positions(spark, d):
    return bars.gap_flat_positions(_covered(spark, d).withColumn("position", F.lit(1.0))).select("exchange", "bar", "position")


@query("coverage_summary", f"""{ALL_COVERED} SELECT exchange, count(*) AS bars, count(*) FILTER (coverage >= 1) AS "full", count(*) FILTER (coverage > 0 AND coverage < 1) AS partial, count(*) FILTER (coverage <= 0) AS empty, CAST(coalesce(sum(gap_ms), 0) AS BIGINT) AS gap_ms, count(DISTINCT segment) FILTER (coverage >= 1) AS segments FROM covered GROUP BY 1""")
def coverage_summary(spark, d):
    return bars.coverage_summary(_covered(spark, d))


DAILY_SQL = f"dv AS (SELECT exchange, ts_ms // {DAY_MS} AS day, sum(qty) AS volume FROM tape GROUP BY 1, 2)"
CAUSAL_SQL = """causal AS (SELECT a.exchange, a.day, median(b.volume) / 20 AS bucket_volume FROM dv a LEFT JOIN dv b ON a.exchange = b.exchange AND b.day < a.day AND b.volume > 0 GROUP BY 1, 2)"""


@query("causal_bucket_volume", f"WITH {TAPE_SQL}, {DAILY_SQL}, {CAUSAL_SQL} SELECT exchange, day, {sql_rounded('bucket_volume')} FROM causal")
def causal_bucket_volume(spark, d):
    return rounded(bars.causal_bucket_volume(bars.daily_volume(tape(spark, d)), 20), "bucket_volume")


BUCKETS_SQL = f"""{DAILY_SQL}, {CAUSAL_SQL},
t1 AS (SELECT t.*, t.ts_ms // {DAY_MS} AS day, bucket_volume AS v, sum(qty) OVER (PARTITION BY t.exchange, t.ts_ms // {DAY_MS} ORDER BY ts_ms, trade_id ROWS UNBOUNDED PRECEDING) AS c1 FROM tape t JOIN causal c ON t.exchange = c.exchange AND t.ts_ms // {DAY_MS} = c.day WHERE qty > 0 AND bucket_volume > 0),
t2 AS (SELECT *, c1 - qty AS c0, unnest(range(CAST(floor((c1 - qty) / v) AS BIGINT), greatest(CAST(ceil(c1 / v) AS BIGINT), CAST(floor((c1 - qty) / v) AS BIGINT) + 1))) AS k FROM t1),
t3 AS (SELECT *, least(c1, (k + 1) * v) - greatest(c0, k * v) AS part FROM t2),
b0 AS (SELECT exchange, day, k, max(v) AS bucket_volume, min(ts_ms) AS open_ms, max(ts_ms) AS close_ms, sum(part) AS volume, sum(CASE WHEN aggressor_buy THEN part ELSE 0 END) AS buy, sum(CASE WHEN NOT aggressor_buy THEN part ELSE 0 END) AS sell FROM t3 WHERE part > 0 GROUP BY 1, 2, 3),
b1 AS (SELECT *, abs(buy - sell) / bucket_volume AS imbalance FROM b0 WHERE volume >= bucket_volume * (1 - 1e-9)),
buckets AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN avg(imbalance) OVER w END AS vpin FROM b1 WINDOW w AS (PARTITION BY exchange ORDER BY day, k ROWS 9 PRECEDING))"""


CLOCK = "buy sell imbalance vpin duration_s window_span_s window_gap_s"


@query("volume_buckets", f"""WITH {TAPE_SQL}, {BUCKETS_SQL}, st AS (SELECT exchange, day, k, ts_ms - lag(ts_ms) OVER (PARTITION BY exchange, day, k ORDER BY ts_ms) AS dt FROM t3 WHERE part > 0),
si AS (SELECT exchange, day, k, count(*) AS trade_count, coalesce(sum(dt) FILTER (dt > 600000), 0) AS within_ms FROM st GROUP BY 1, 2, 3),
be AS (SELECT b.*, trade_count, within_ms, CASE WHEN open_ms - lag(close_ms) OVER w > 600000 THEN open_ms - lag(close_ms) OVER w ELSE 0 END AS between_ms FROM buckets b JOIN si USING (exchange, day, k) WINDOW w AS (PARTITION BY exchange ORDER BY day, k)),
wi AS (SELECT *, (close_ms - open_ms) / 1000 AS duration_s, (close_ms - lag(open_ms, 9) OVER o) / 1000 AS window_span_s, CASE WHEN lag(open_ms, 9) OVER o IS NOT NULL THEN (sum(within_ms) OVER w + sum(between_ms) OVER (PARTITION BY exchange ORDER BY day, k ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) / 1000 END AS window_gap_s FROM be WINDOW o AS (PARTITION BY exchange ORDER BY day, k), w AS (PARTITION BY exchange ORDER BY day, k ROWS 9 PRECEDING))
SELECT exchange, day, k, open_ms, close_ms, trade_count, {sql_rounded(CLOCK)} FROM wi""")
def volume_buckets(spark, d):
    return rounded(bars.volume_buckets(tape(spark, d), 20, 10, gap_ms=600_000).select("exchange", "day", "k", "open_ms", "close_ms", "trade_count", *CLOCK.split()), CLOCK)


@query("vpin_on_grid", f"""{ALL_COVERED.replace("WITH ", "WITH ", 1)}, {BUCKETS_SQL}, closed AS (SELECT exchange, close_ms, last(vpin ORDER BY day, k) AS vpin FROM buckets WHERE vpin IS NOT NULL GROUP BY 1, 2)
SELECT c.exchange, c.bar, round(b.vpin, 6) + 0.0 AS vpin, (c.bar + 1) * {HOUR} - b.close_ms AS vpin_age_ms FROM covered c ASOF LEFT JOIN closed b ON c.exchange = b.exchange AND (c.bar + 1) * {HOUR} > b.close_ms""")
def vpin_on_grid(spark, d):
    return rounded(bars.order_flow_bars(tape(spark, d), START, END, HOUR, GAP).select("exchange", "bar", "vpin", "vpin_age_ms"), "vpin")


def _legs(spark, d):
    t = tape(spark, d)
    return t.filter("exchange = 'click'").select("symbol", "trade_id", "ts_ms"), t.filter("exchange = 'view'").select("symbol", F.col("ts_ms").alias("quote_ms"), F.col("price").alias("quote"), F.col("trade_id").cast("long").alias("quote_id"))


LEGS_SQL = "l AS (SELECT symbol, trade_id, ts_ms FROM tape WHERE exchange = 'click'), r AS (SELECT symbol, ts_ms AS quote_ms, price AS quote FROM tape WHERE exchange = 'view')"


@query("asof_backward", f"WITH {TAPE_SQL}, {LEGS_SQL} SELECT l.symbol, trade_id, ts_ms, quote_ms, quote FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts_ms >= r.quote_ms")
def asof_backward(spark, d):
    return asof.asof_join(*_legs(spark, d), ["symbol"], "ts_ms", "quote_ms", ties=("quote_id",))


@query("asof_forward", f"WITH {TAPE_SQL}, {LEGS_SQL} SELECT l.symbol, trade_id, ts_ms, CASE WHEN quote_ms - ts_ms <= 900000 THEN quote_ms END AS quote_ms, CASE WHEN quote_ms - ts_ms <= 900000 THEN quote END AS quote FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts_ms < r.quote_ms")
def asof_forward(spark, d):
    return asof.asof_join(*_legs(spark, d), ["symbol"], "ts_ms", "quote_ms", forward=True, strict=True, tolerance=900_000, ties=("quote_id",))


FEATURES = "mid spread_bps microprice imbalance bid_depth ask_depth bid_slope ask_slope"
_slope = lambda side: f"(SELECT CASE WHEN sum(d * d) <> 0 THEN sum(d * q) / sum(d * d) END FROM (SELECT abs(x[1] - mid) / mid * 10000 AS d, sum(x[2]) OVER (ORDER BY i) AS q FROM (SELECT unnest({side}[1:10]) AS x, unnest(range(10)) AS i)))"
BOOK_SQL = f"""{book_sql()}, f0 AS (SELECT exchange, symbol, ts_ms, bids, asks, bids[1][1] AS bid, bids[1][2] AS bid_qty, asks[1][1] AS ask, asks[1][2] AS ask_qty, (bids[1][1] + asks[1][1]) / 2 AS mid, CASE WHEN len(bids) >= 10 THEN list_sum(list_transform(bids[1:10], lambda x: x[2])) END AS bid_depth, CASE WHEN len(asks) >= 10 THEN list_sum(list_transform(asks[1:10], lambda x: x[2])) END AS ask_depth FROM book),
f AS (SELECT *, (ask - bid) / mid * 10000 AS spread_bps, (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty) AS microprice, bid_qty / (bid_qty + ask_qty) AS imbalance,
    CASE WHEN len(bids) >= 10 THEN {_slope('bids')} END AS bid_slope, CASE WHEN len(asks) >= 10 THEN {_slope('asks')} END AS ask_slope FROM f0)"""


@query("book_features", f"WITH {BOOK_SQL} SELECT exchange, ts_ms, {sql_rounded(FEATURES)} FROM f")
def book_features(spark, d):
    return rounded(books.book_features(book(spark, d)).select("exchange", "ts_ms", *FEATURES.split()), FEATURES)


OFI_SQL = f"""o AS (SELECT exchange, ts_ms, mid, ts_ms - lag(ts_ms) OVER w AS pair_ms, CASE WHEN ts_ms - lag(ts_ms) OVER w <= 30000 THEN
    CASE WHEN bid >= lag(bid) OVER w THEN bid_qty ELSE 0 END - CASE WHEN bid <= lag(bid) OVER w THEN lag(bid_qty) OVER w ELSE 0 END
    - CASE WHEN ask <= lag(ask) OVER w THEN ask_qty ELSE 0 END + CASE WHEN ask >= lag(ask) OVER w THEN lag(ask_qty) OVER w ELSE 0 END END AS ofi FROM f WINDOW w AS (PARTITION BY exchange, symbol, ts_ms // {DAY_MS} ORDER BY ts_ms))"""


@query("book_ofi", f"WITH {BOOK_SQL}, {OFI_SQL} SELECT exchange, ts_ms, {sql_rounded('ofi')} FROM o")
def book_ofi(spark, d):
    return rounded(books.ofi(books.book_features(book(spark, d)), 30_000).select("exchange", "ts_ms", "ofi"), "ofi")


@query("book_bars", f"WITH {BOOK_SQL}, {OFI_SQL} SELECT exchange, ts_ms // 60000 AS bar, round(last(mid ORDER BY ts_ms), 6) + 0.0 AS mid, round(sum(ofi), 6) + 0.0 AS ofi, count(ofi) AS ofi_n, count(*) FILTER (pair_ms > 30000) AS ofi_gap_pairs, count(*) AS snapshots FROM o GROUP BY 1, 2")
def book_bars(spark, d):
    return rounded(books.book_bars(book(spark, d), 60_000, 30_000).select("exchange", "bar", "mid", "ofi", "ofi_n", "ofi_gap_pairs", "snapshots"), "mid ofi")


@query("book_walk", f"""WITH {book_sql()}, x AS (SELECT exchange, ts_ms, unnest(asks) AS l, unnest(range(16)) AS i FROM book),
y AS (SELECT *, coalesce(sum(l[1] * l[2]) OVER (PARTITION BY exchange, ts_ms ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT exchange, ts_ms, round(CASE WHEN sum(l[1] * l[2]) >= 50 THEN 50 / sum(greatest(least(50 - before, l[1] * l[2]), 0) / l[1]) END, 6) + 0.0 AS buy_px FROM y GROUP BY 1, 2""")
def book_walk(spark, d):
    return rounded(books.book_walk(book(spark, d), 50.0).select("exchange", "ts_ms", "buy_px"), "buy_px")


@query("ladder_rows", f"""WITH {book_sql()}, s AS (SELECT exchange, ts_ms, (bids[1][1] + asks[1][1]) / 2 AS mid, bids, asks FROM book),
x AS (SELECT exchange, ts_ms, mid, 'bid' AS side, unnest(bids) AS l FROM s UNION ALL SELECT exchange, ts_ms, mid, 'ask', unnest(asks) FROM s),
g AS (SELECT exchange, ts_ms, side, CASE WHEN side = 'bid' THEN floor(l[1]) ELSE ceil(l[1]) END AS price, sum(l[2]) AS qty, max(mid) AS mid FROM x GROUP BY 1, 2, 3, 4)
SELECT exchange, ts_ms, side, price, round(qty, 6) + 0.0 AS qty, row_number() OVER w AS row, round(sum(qty) OVER (w ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS total, round(abs(price - mid), 6) AS ticks FROM g WINDOW w AS (PARTITION BY exchange, ts_ms, side ORDER BY abs(price - mid)) QUALIFY row <= 5""")
def ladder_rows(spark, d):
    out = books.ladder_rows(book(spark, d), 1.0, 5)
    return rounded(out.select("exchange", "ts_ms", "side", "price", "qty", F.col("row").cast("long").alias("row"), "total", "ticks"), "qty total")


GROUPED_SQL = """s AS (SELECT exchange, ts_ms, (bids[1][1] + asks[1][1]) / 2 AS mid, bids, asks FROM book), x AS (SELECT exchange, ts_ms, mid, 'bid' AS side, unnest(bids) AS l FROM s UNION ALL SELECT exchange, ts_ms, mid, 'ask', unnest(asks) FROM s),
g0 AS (SELECT exchange, ts_ms, side, CASE WHEN side = 'bid' THEN floor(l[1]) ELSE ceil(l[1]) END AS price, sum(l[2]) AS qty, max(mid) AS mid FROM x GROUP BY 1, 2, 3, 4), g AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY exchange, ts_ms, side ORDER BY abs(price - mid)) <= 5)"""


@query("depth_velocity", f"""WITH {book_sql()}, {GROUPED_SQL}, e AS (SELECT exchange, max(ts_ms) AS b FROM book GROUP BY 1), e2 AS (SELECT e.exchange, b, min(ts_ms) AS a FROM e JOIN book ON e.exchange = book.exchange AND ts_ms >= b - 60000 GROUP BY 1, 2),
q AS (SELECT g.exchange, price, coalesce(sum(qty) FILTER (ts_ms = b), 0) AS qty, coalesce(sum(qty) FILTER (ts_ms = a), 0) AS was, any_value(b - a) / 1000 AS s FROM g JOIN e2 ON g.exchange = e2.exchange AND ts_ms IN (a, b) GROUP BY 1, 2)
SELECT exchange, price, round(qty, 6) + 0.0 AS qty, round(CASE WHEN s > 0 THEN (qty - was) / s ELSE 0 END, 6) + 0.0 AS velocity FROM q""")
def depth_velocity(spark, d):
    return rounded(books.depth_velocity(book(spark, d), 1.0, 5, 60_000), "qty velocity")


@query("depth_range", f"WITH {book_sql()}, {GROUPED_SQL} SELECT exchange, ts_ms, min(price) AS low, max(price) AS high FROM g GROUP BY 1, 2")
def depth_range(spark, d):
    return books.depth_range(book(spark, d), 1.0, 5)


@query("depth_imbalance", f"""WITH {book_sql()}, s AS (SELECT exchange, ts_ms, (bids[1][1] + asks[1][1]) / 2 AS mid, bids, asks FROM book), v AS (SELECT exchange, ts_ms, list_sum([x[2] for x in bids if abs(x[1] - mid) <= 3]) AS b, list_sum([x[2] for x in asks if abs(x[1] - mid) <= 3]) AS a FROM s)
SELECT exchange, ts_ms, round((b - a) / (b + a), 6) + 0.0 AS imbalance FROM v""")
def depth_imbalance(spark, d):
    f = books.book_features(book(spark, d))
    return rounded(f.select("exchange", "ts_ms", books.depth_imbalance("bids", "asks", F.col("mid"), 3.0).alias("imbalance")), "imbalance")


@query("merged_book", f"""WITH {book_sql()}, x AS (SELECT exchange, ts_ms // 10000 AS slot, 'bid' AS side, unnest(bids[1:5]) AS l FROM book UNION ALL SELECT exchange, ts_ms // 10000, 'ask', unnest(asks[1:5]) FROM book)
SELECT slot AS ts_ms, side, round(l[1]) AS price, round(sum(l[2]), 6) + 0.0 AS qty, count(DISTINCT exchange) AS venues FROM x GROUP BY 1, 2, 3""")
def merged_book(spark, d):
    b = book(spark, d)
    b = b.withColumn("exchange", F.concat_ws("|", "exchange", "ts_ms")).withColumn("ts_ms", F.floor(F.col("ts_ms") / 10_000).cast("long"))
    out = books.merged_book(b, 1.0, 5)
    venues = F.size(F.array_distinct(F.transform(F.map_keys("by_exchange"), lambda k: F.split(k, r"\|")[0]))).cast("long")
    return rounded(out.select("ts_ms", "side", "price", "qty", venues.alias("venues")), "qty")
