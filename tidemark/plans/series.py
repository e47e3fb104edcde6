"""Queries of cleaning, provenance, recorded frames and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import books, quality, wire
from tidemark.operators import series as sr
from tidemark.plans.backtests import _board, _trend
from tidemark.plans.bars import ALL_COVERED, _covered
from tidemark.plans.features import D, _prices
from tidemark.plans.registry import query, rounded
from tidemark.sources.schemas import TAPE_SQL, book, book_sql, read, tape

T = f"WITH {TAPE_SQL}"


@query("normalize_ohlcv", "SELECT l_orderkey AS series, l_linenumber AS ts, l_quantity AS open, l_extendedprice AS high, CAST(NULL AS DOUBLE) AS low, l_discount AS close, l_tax AS volume FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) = 1")
def normalize_ohlcv(spark, d):
    i = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").alias("ts"), F.struct("l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("arrival"), F.col("l_quantity").cast("string").alias("open"), F.col("l_extendedprice").alias("high"), F.lit("n/a").alias("low"), F.col("l_discount").alias("close"), F.col("l_tax").alias("volume"))
    return sr.normalize_ohlcv(i, "arrival")


@query("align", f"WITH {D}, p AS (SELECT series, day, CAST(volume > 1 AS DOUBLE) AS position FROM daily WHERE volume > 1) SELECT p.series, p.day, position, close FROM p JOIN daily USING (series, day)")
def align(spark, d):
    p = _prices(spark, d)
    twice = p.select("series", "day", "close").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("close", F.when(F.col("n") == 1, F.col("close")).otherwise(0.0))
    return sr.align(p.filter("volume > 1").select("series", "day", F.lit(1.0).alias("position"), F.lit(1).alias("n")), twice, "n")


@query("buy_and_hold_equity", f"WITH {D} SELECT series, day, round(close / first_value(close) OVER (PARTITION BY series ORDER BY day), 6) + 0.0 AS equity FROM daily")
def buy_and_hold_equity(spark, d):
    return rounded(sr.buy_and_hold_equity(_prices(spark, d)).select("series", "day", "equity"), "equity")


@query("slice_range", f"{T} SELECT trade_id, ts_ms FROM tape WHERE ts_ms BETWEEN 1704153600000 AND 1704240000000")
def slice_range(spark, d):
    return sr.slice_range(tape(spark, d), 1_704_153_600_000, 1_704_240_000_000, "ts_ms").select("trade_id", "ts_ms")


@query("last_finite", f"{T}, x AS (SELECT exchange, ts_ms, CASE WHEN qty > 10 THEN price END AS x FROM tape) SELECT exchange, ts_ms // 3600000 AS bar, arg_max(x, ts_ms) FILTER (x IS NOT NULL) AS x FROM x GROUP BY 1, 2")
def last_finite(spark, d):
    x = F.when(F.col("qty") > 10, F.col("price")).otherwise(F.when(F.col("qty") > 5, F.lit(float("nan"))))
    t = tape(spark, d).withColumn("x", x)
    return t.groupBy("exchange", F.floor(F.col("ts_ms") / 3_600_000).cast("long").alias("bar")).agg(sr.last_finite("x", "ts_ms").alias("x"))


@query("periods_per_year", f"{T}, x AS (SELECT exchange AS series, ts_ms - lag(ts_ms) OVER (PARTITION BY exchange ORDER BY ts_ms) AS d FROM tape) SELECT series, round(365 * 86400000.0::DOUBLE / quantile_cont(d, 0.5), 4) + 0.0 AS per_year FROM x WHERE d > 0 GROUP BY 1")
def periods_per_year(spark, d):
    return rounded(sr.periods_per_year(tape(spark, d).withColumnRenamed("exchange", "series")), "per_year", 4)


@query("backtest_report")
def backtest_report(spark, d):
    return sr.report(bt.run(_trend(spark, d)))


@query("segments", f"""{ALL_COVERED} SELECT exchange, dense_rank() OVER (PARTITION BY exchange ORDER BY segment) - 1 AS segment, min(bar) AS first_bar, max(bar) AS last_bar, count(*) AS bars FROM covered WHERE coverage >= 1 GROUP BY exchange, covered.segment""")
def segments(spark, d):
    return sr.segments(_covered(spark, d).drop("segment"))


@query("source_labels", f"{T}, s AS (SELECT trade_id, CAST(trade_id AS BIGINT) % 4 AS c FROM tape) SELECT trade_id, CASE c WHEN 1 THEN 'local' WHEN 2 THEN 'hub' END AS label FROM s WHERE c <> 3")
def source_labels(spark, d):
    t = tape(spark, d).select("trade_id", (F.col("trade_id").cast("long") % 4).alias("source_code"))
    return sr.drop_archive_bars(t).select("trade_id", sr.source_label(F.col("source_code")).alias("label"))


@query("history_summary", f"{T} SELECT round((max(ts_ms) - min(ts_ms)) / (365 * 86400000.0), 6) + 0.0 AS years FROM tape")
def history_summary(spark, d):
    return rounded(sr.history_summary(quality.manifest(tape(spark, d))).select("years"), "years")


@query("provenance", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in sr.COLUMNS) + ') t("column", formula, unit)')
def provenance(spark, d):
    return sr.provenance(spark)


@query("dsr_variances")
def dsr_variances(spark, d):
    return rounded(sr.dsr_variances(bt.stats(_board(spark, d), ["strategy"]), 4), "sr bar_a bar_b1 bar_b2")


@query("pooled_markout")
def pooled_markout(spark, d):
    t = tape(spark, d).withColumn("day", F.floor(F.col("ts_ms") / 86_400_000).cast("long"))
    days = t.groupBy(F.col("exchange").alias("horizon"), "day").agg(F.percentile("price", F.lit(0.5)).alias("median"), F.avg("price").alias("mean"))
    return rounded(sr.pooled(days), "median mean lo hi")


@query("frame_census", f"""{T}, f AS (SELECT CASE WHEN qty = 0 THEN 'gap' WHEN qty = 1 THEN 'snapshot' ELSE 'frame' END AS kind, ts_ms + CAST(floor(price) AS BIGINT) AS recv_ms, ts_ms FROM tape), g AS (SELECT recv_ms // 3600000 AS hour, count(*) FILTER (kind = 'frame') AS frames, count(*) FILTER (kind = 'gap') AS gaps, count(*) FILTER (kind = 'snapshot') AS snapshots, list_sort(list(recv_ms - ts_ms) FILTER (kind = 'frame')) AS l FROM f GROUP BY 1)
SELECT hour, frames, gaps, snapshots, l[greatest(CAST(ceil(0.5 * len(l)) AS BIGINT), 1)] AS p50, l[greatest(CAST(ceil(0.99 * len(l)) AS BIGINT), 1)] AS p99 FROM g""")
def frame_census(spark, d):
    t = tape(spark, d)
    kind = F.when(F.col("qty") == 0, "gap").when(F.col("qty") == 1, "snapshot").otherwise("frame")
    return sr.frame_census(t.select(kind.alias("kind"), (F.col("ts_ms") + F.floor("price")).alias("recv_ms"), F.col("ts_ms").alias("event_ms")))


@query("rebuilt_agreement")
def rebuilt_agreement(spark, d):
    b = books.parsed(book(spark, d))
    return sr.rebuilt_agreement(b.select(F.col("exchange").alias("symbol"), F.col("ts_ms").alias("seq"), F.when(F.col("ts_ms") % 5000 == 0, "snapshot").otherwise("update").alias("kind"), "bids", "asks"))


@query("multi_level_ofi", f"""WITH {book_sql()}, l AS (SELECT exchange, ts_ms, bids, asks, lag(bids) OVER w AS b0, lag(asks) OVER w AS a0 FROM book WINDOW w AS (PARTITION BY exchange ORDER BY ts_ms)),
o AS (SELECT exchange, ts_ms, CASE WHEN b0 IS NOT NULL THEN list_sum([CASE WHEN bids[i][1] >= b0[i][1] THEN bids[i][2] ELSE 0 END - CASE WHEN bids[i][1] <= b0[i][1] THEN b0[i][2] ELSE 0 END - CASE WHEN asks[i][1] <= a0[i][1] THEN asks[i][2] ELSE 0 END + CASE WHEN asks[i][1] >= a0[i][1] THEN a0[i][2] ELSE 0 END for i in [1, 2, 3]]) END AS ofi FROM l)
SELECT exchange, ts_ms, round(ofi, 6) + 0.0 AS ofi, round(sum(ofi) OVER (PARTITION BY exchange ORDER BY ts_ms RANGE 59999 PRECEDING), 6) + 0.0 AS ofi_sum FROM o""")
def multi_level_ofi(spark, d):
    return rounded(sr.multi_level_ofi(books.parsed(book(spark, d)), 3, 60_000, 10).select("exchange", "ts_ms", "ofi", "ofi_sum"), "ofi ofi_sum")


@query("pulled_walls")
def pulled_walls(spark, d):
    f = books.parsed(book(spark, d)).select("exchange", "ts_ms", F.explode("bids").alias("x")).select("exchange", "ts_ms", F.lit("bid").alias("side"), F.col("x")[0].alias("price"), F.col("x")[1].alias("qty"))
    t = tape(spark, d).select(F.lit("0").alias("exchange"), F.floor("price").cast("double").alias("price"), (F.col("ts_ms") % 500_000).alias("ts_ms"), "qty")
    return sr.pulled_walls(f, t, 2.0)


@query("journal_csv_round_trip", f"{T} SELECT ts_ms, exchange AS symbol, CASE WHEN aggressor_buy THEN 'long' ELSE 'short' END AS side, price AS r, trade_id AS tag, concat('a \"b\", ', trade_id) AS note, 0 AS errors FROM tape")
def journal_csv_round_trip(spark, d):
    j = tape(spark, d).select("ts_ms", F.col("exchange").alias("symbol"), F.when(F.col("aggressor_buy"), "long").otherwise("short").alias("side"), F.col("price").alias("r"), F.col("trade_id").alias("tag"), F.concat(F.lit('a "b", '), "trade_id").alias("note"))
    return sr.journal_from_csv(sr.journal_to_csv(j)).withColumn("errors", F.size("errors"))


@query("book_checksum")
def book_checksum(spark, d):
    b = books.parsed(book(spark, d))
    text = lambda c: F.transform(c, lambda x: F.array(x[0].cast("string"), x[1].cast("string")))
    return b.select("exchange", "ts_ms", wire.book_checksum(text("bids"), text("asks")).alias("checksum"))


@query("venue_ids", "SELECT DISTINCT p_brand AS symbol, upper(p_brand) || 'USDT' AS binance, upper(p_brand) || '-USDT-SWAP' AS okx, upper(p_brand) || '-USD' AS coinbase FROM part")
def venue_ids(spark, d):
    return read(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn("v", sr.venue_ids(F.col("symbol"))).select("symbol", "v.binance", "v.okx", "v.coinbase")
