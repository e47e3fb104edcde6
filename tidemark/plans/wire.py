"""Queries that wrap the tape in venue frames and normalize them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import wire
from tidemark.plans.registry import query, rounded
from tidemark.sources.schemas import TAPE_SQL, tape

T = f"WITH {TAPE_SQL}"


def frames(spark, d, struct: str, wrap: str = "{x}", group: str | None = None):
    """One frame for each row (or for each value of group): struct is SQL over the tape, wrap puts it in its envelope."""
    t = tape(spark, d)
    if group:
        rows = t.groupBy(F.expr(group).alias("seq")).agg(F.expr(f"sort_array(collect_list({struct}))").alias("x"))
        return rows.select("seq", F.expr(f"to_json({wrap.format(x='x')})").alias("frame"))
    return t.select(F.expr(f"to_json({wrap.format(x=struct)})").alias("frame"))


@query("wire_bybit_trades", f"{T} SELECT 'bybit' AS exchange, exchange AS symbol, trade_id, ts_ms, price, qty, aggressor_buy FROM tape")
def bybit_trades(spark, d):
    f = frames(spark, d, "named_struct('i', trade_id, 'T', ts_ms, 'p', cast(price as string), 'v', cast(qty as string), 'S', if(aggressor_buy, 'Buy', 'Sell'), 's', exchange)", "named_struct('topic', 'publicTrade', 'data', {x})", "ts_ms div 3600000")
    return wire.bybit_trades(f)


@query("wire_bybit_liquidations", f"{T} SELECT 'bybit' AS exchange, exchange AS symbol, ts_ms, CASE WHEN aggressor_buy THEN 'short' ELSE 'long' END AS side, price, qty, round(price * qty, 6) + 0.0 AS notional_usd FROM tape")
def bybit_liquidations(spark, d):
    f = frames(spark, d, "named_struct('T', ts_ms, 's', exchange, 'S', if(aggressor_buy, 'Buy', 'Sell'), 'v', cast(qty as string), 'p', cast(price as string))", "named_struct('data', {x})", "ts_ms div 3600000")
    return rounded(wire.bybit_liquidations(f), "notional_usd")


@query("wire_bybit_tickers", f"""{T}, x AS (SELECT exchange AS symbol, ts_ms, trade_id, CASE WHEN CAST(trade_id AS BIGINT) % 50 = 0 THEN 1 ELSE 0 END AS snap, price, qty, CAST(trade_id AS BIGINT) % 3 AS k FROM tape),
y AS (SELECT *, sum(snap) OVER (PARTITION BY symbol ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS ep FROM x), z AS (SELECT symbol, ts_ms, last_value(CASE WHEN snap = 1 OR k = 0 THEN price END IGNORE NULLS) OVER w AS mark_price, last_value(CASE WHEN snap = 1 OR k = 1 THEN qty END IGNORE NULLS) OVER w AS oi, ep FROM y WINDOW w AS (PARTITION BY symbol, ep ORDER BY ts_ms ROWS UNBOUNDED PRECEDING))
SELECT symbol, ts_ms, mark_price, oi FROM z WHERE ep > 0 AND mark_price IS NOT NULL AND oi IS NOT NULL""")
def bybit_tickers(spark, d):
    snap = "cast(trade_id as bigint) % 50 = 0"
    body = f"named_struct('type', if({snap}, 'snapshot', 'delta'), 'ts', ts_ms, 'data', named_struct('symbol', exchange, 'fundingRate', if({snap}, '0.0001', null), 'nextFundingTime', if({snap}, '0', null), 'markPrice', if({snap} or cast(trade_id as bigint) % 3 = 0, cast(price as string), null), 'indexPrice', if({snap}, '1', null), 'openInterest', if({snap} or cast(trade_id as bigint) % 3 = 1, cast(qty as string), null)))"
    return wire.bybit_tickers(frames(spark, d, body)).select("symbol", "ts_ms", "mark_price", "oi")


@query("wire_binance_agg_trades", f"{T} SELECT 'binance' AS exchange, 'EVT' AS symbol, trade_id, ts_ms, price, qty, aggressor_buy FROM tape")
def binance_agg_trades(spark, d):
    f = frames(spark, d, "named_struct('a', cast(trade_id as bigint), 'p', cast(price as string), 'q', cast(qty as string), 'T', ts_ms, 'm', not aggressor_buy)", "{x}", "ts_ms div 3600000")
    return wire.binance_agg_trades(f, "EVT")


@query("wire_binance_crowding", f"{T} SELECT 'binance' AS exchange, exchange AS symbol, ts_ms, m AS metric, CASE WHEN m = 'long_short' THEN price ELSE qty END AS value FROM tape, (SELECT unnest(['long_short', 'open_interest']) AS m)")
def binance_crowding(spark, d):
    f = frames(spark, d, "named_struct('symbol', exchange, 'timestamp', ts_ms, 'ratio', cast(price as string), 'oi', cast(qty as string))", "{x}", "ts_ms div 3600000")
    return wire.binance_crowding(f, {"ratio": "long_short", "oi": "open_interest"}, "EVT")


@query("wire_binance_premium_index", f"{T} SELECT 'binance' AS exchange, exchange AS symbol, ts_ms, 0.0001::DOUBLE AS funding_rate, ts_ms + 1 AS next_funding_ts, price AS mark_price, qty AS index_price FROM tape")
def binance_premium_index(spark, d):
    return wire.binance_premium_index(frames(spark, d, "named_struct('symbol', exchange, 'time', ts_ms, 'lastFundingRate', '0.0001', 'nextFundingTime', ts_ms + 1, 'markPrice', cast(price as string), 'indexPrice', cast(qty as string))"))


@query("wire_binance_depth", f"{T} SELECT exchange AS symbol, ts_ms, price - 1 AS bid, price + 1 AS ask FROM tape")
def binance_depth(spark, d):
    levels = "array(array(cast(price {o} 2 as string), '1'), array(cast(price {o} 1 as string), '2'), array(cast(price {o} 3 as string), '0'))"
    f = frames(spark, d, f"named_struct('E', ts_ms, 's', exchange, 'b', {levels.format(o='-')}, 'a', {levels.format(o='+')})")
    best = lambda c: F.get(F.get(F.from_json(c, "array<array<double>>"), F.lit(0)), F.lit(0))
    return wire.binance_depth(f).select("symbol", "ts_ms", best("bids").alias("bid"), best("asks").alias("ask"))


@query("wire_okx_trades", f"{T} SELECT 'okx' AS exchange, exchange AS symbol, trade_id, ts_ms, price, round(qty * 0.01, 6) + 0.0 AS qty, aggressor_buy FROM tape")
def okx_trades(spark, d):
    f = frames(spark, d, "named_struct('instId', exchange, 'tradeId', trade_id, 'px', cast(price as string), 'sz', cast(qty as string), 'side', if(aggressor_buy, 'buy', 'sell'), 'ts', cast(ts_ms as string))", "named_struct('data', {x})", "ts_ms div 3600000")
    return rounded(wire.okx_trades(f), "qty")


@query("wire_okx_funding", f"{T} SELECT exchange AS symbol, ts_ms, price AS funding_rate, ts_ms + 5 AS next_funding_ts FROM tape WHERE aggressor_buy")
def okx_funding(spark, d):
    f = frames(spark, d, "array(named_struct('instId', exchange, 'ts', cast(ts_ms as string), 'fundingRate', cast(price as string), 'nextFundingTime', cast(ts_ms + 5 as string)))", "named_struct('code', if(aggressor_buy, '0', '1'), 'data', {x})")
    return wire.okx_funding(f).select("symbol", "ts_ms", "funding_rate", "next_funding_ts")


@query("wire_coinbase_trades", f"{T} SELECT 'coinbase' AS exchange, exchange AS symbol, trade_id, ts_ms, price, qty, aggressor_buy FROM tape")
def coinbase_trades(spark, d):
    f = frames(spark, d, "named_struct('trade_id', trade_id, 'product_id', exchange, 'price', cast(price as string), 'size', cast(qty as string), 'time', date_format(timestamp_millis(ts_ms), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\"), 'side', if(aggressor_buy, 'SELL', 'BUY'))", "named_struct('trades', {x})", "cast(trade_id as bigint) div 100")
    again = f.withColumn("seq", F.col("seq") + 1)  # a reconnect sends the page before once more
    return wire.coinbase_trades(f.unionByName(again))


@query("wire_deribit_dvol", f"{T} SELECT exchange AS symbol, ts_ms, price AS dvol FROM tape")
def deribit_dvol(spark, d):
    f = frames(spark, d, "named_struct('usOut', ts_ms * 1000 + 7, 'result', named_struct('index_name', exchange, 'volatility', price))")
    return wire.deribit_dvol(f).select("symbol", "ts_ms", "dvol")


@query("wire_deribit_chain", f"{T} SELECT ts_ms, price / 100 AS mark_iv, 1735977600000 AS expiry_ts, CAST(CAST(qty AS BIGINT) * 1000 AS DOUBLE) AS strike, CASE WHEN aggressor_buy THEN 'C' ELSE 'P' END AS cp FROM tape WHERE exchange <> 'error'")
def deribit_chain(spark, d):
    name = "if(exchange = 'error', 'BTC-PERPETUAL', concat('BTC-4JAN25-', cast(qty as bigint) * 1000, '-', if(aggressor_buy, 'C', 'P')))"
    f = frames(spark, d, f"named_struct('usOut', ts_ms * 1000, 'result', array(named_struct('instrument_name', {name}, 'mark_iv', price, 'open_interest', qty, 'volume', qty, 'underlying_price', price)))")
    return wire.deribit_chain(f).select("ts_ms", "mark_iv", "expiry_ts", "strike", "cp")


@query("wire_klines", f"{T} SELECT exchange AS series, ts_ms, price AS open, price + 1 AS high, price - 1 AS low, price AS close, qty AS volume FROM tape")
def klines(spark, d):
    f = frames(spark, d, "named_struct('symbol', exchange, 'list', array(array(cast(ts_ms as string), cast(price as string), cast(price + 1 as string), cast(price - 1 as string), cast(price as string), cast(qty as string))))", "named_struct('result', {x})")
    return wire.klines(f)


@query("wire_ticker_vwap", f"{T} SELECT exchange AS symbol, round(price * 2, 6) + 0.0 AS turnover, round(CASE WHEN qty <> 0 THEN price * 2 / qty END, 6) + 0.0 AS vwap FROM tape")
def ticker_vwap(spark, d):
    f = frames(spark, d, "named_struct('list', array(named_struct('symbol', exchange, 'lastPrice', cast(price as string), 'turnover24h', cast(price * 2 as string), 'volume24h', cast(qty as string))))", "named_struct('result', {x})")
    return rounded(wire.ticker_vwap(f).select("symbol", "turnover", "vwap"), "turnover vwap")


@query("wire_leaderboard", f"{T} SELECT trade_id AS address, price AS value FROM tape ORDER BY price DESC, trade_id LIMIT 20")
def leaderboard(spark, d):
    return wire.leaderboard(frames(spark, d, "array(named_struct('ethAddress', trade_id, 'accountValue', cast(price as string)))", "named_struct('leaderboardRows', {x})"), 20)


@query("wire_positions", f"{T} SELECT exchange AS symbol, CASE WHEN aggressor_buy THEN 'long' ELSE 'short' END AS side, qty, price AS entry FROM tape WHERE qty > 0")
def positions(spark, d):
    body = "array(named_struct('position', named_struct('coin', exchange, 'szi', cast(if(aggressor_buy, qty, -qty) as string), 'entryPx', cast(price as string), 'positionValue', '1')))"
    return wire.positions(frames(spark, d, body, "named_struct('assetPositions', {x})")).select("symbol", "side", "qty", "entry").filter("qty > 0")


@query("wire_mids", f"{T} SELECT trade_id AS symbol, price AS mid FROM tape")
def mids(spark, d):
    return wire.mids(frames(spark, d, "map(trade_id, cast(price as string))"))


@query("wire_prediction_events", f"{T} SELECT trade_id AS question, o AS outcome, CASE WHEN o = 'Yes' THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS probability FROM tape, (SELECT unnest(['Yes', 'No']) AS o)")
def prediction_events(spark, d):
    body = "array(named_struct('title', exchange, 'markets', array(named_struct('question', trade_id, 'outcomes', '[\"Yes\",\"No\"]', 'outcomePrices', '[\"0.25\",\"0.75\"]'))))"
    return wire.prediction_events(frames(spark, d, body)).select("question", "outcome", "probability")


@query("wire_news", f"{T} SELECT trade_id AS id, ts_ms, exchange AS title, 1 AS n FROM tape")
def news(spark, d):
    return wire.news(frames(spark, d, "named_struct('_id', trade_id, 'time', ts_ms, 'title', exchange, 'source', 'wire', 'symbols', array(exchange))")).select("id", "ts_ms", "title", F.size("symbols").alias("n"))


@query("wire_calendar", f"{T} SELECT exchange AS title, ts_ms, 'High' AS impact FROM tape")
def calendar(spark, d):
    return wire.calendar(frames(spark, d, "array(named_struct('title', exchange, 'country', 'USD', 'date', date_format(timestamp_millis(ts_ms), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\"), 'impact', 'High'))")).select("title", "ts_ms", "impact")


@query("depth_chain_rule", f"""{T}, x AS (SELECT exchange AS symbol, CAST(trade_id AS BIGINT) AS seq, CAST(trade_id AS BIGINT) * 10 AS a, CAST(trade_id AS BIGINT) * 10 + 9 AS b FROM tape), y AS (SELECT *, CASE WHEN seq % 7 = 0 THEN -1 ELSE lag(b) OVER w END AS pu, lag(b) OVER w AS prev FROM x WINDOW w AS (PARTITION BY symbol ORDER BY seq))
SELECT symbol, seq, CASE WHEN b < 500 THEN 'drop_pre_snapshot' WHEN prev IS NULL OR prev < 500 THEN CASE WHEN a <= 500 THEN 'first_ok' ELSE 'gap' END WHEN pu = prev THEN 'ok' ELSE 'gap' END AS verdict FROM y""")
def depth_chain_rule(spark, d):
    from tidemark.functions.windows import by

    t = tape(spark, d).select(F.col("exchange").alias("symbol"), F.col("trade_id").cast("long").alias("seq"))
    t = t.withColumns({"ev_first": F.col("seq") * 10, "ev_u": F.col("seq") * 10 + 9, "snapshot_last_id": F.lit(500)})
    t = t.withColumn("ev_pu", F.when(F.col("seq") % 7 == 0, -1).otherwise(F.lag("ev_u").over(by("symbol", "seq"))))
    return wire.chain_rule(t).select("symbol", "seq", "verdict")


@query("wire_binance_open_interest", f"{T} SELECT 'binance' AS exchange, exchange AS symbol, ts_ms, qty AS oi FROM tape")
def binance_open_interest(spark, d):
    return wire.binance_open_interest(frames(spark, d, "named_struct('symbol', exchange, 'time', ts_ms, 'openInterest', cast(qty as string))"))


@query("wire_okx_open_interest", f"{T} SELECT 'okx' AS exchange, exchange AS symbol, ts_ms, price AS oi FROM tape WHERE ts_ms // 3600000 % 5 <> 0")
def okx_open_interest(spark, d):
    f = frames(spark, d, "named_struct('instId', exchange, 'ts', cast(ts_ms as string), 'oiCcy', cast(price as string))", "named_struct('code', if(seq % 5 = 0, '50001', '0'), 'data', {x})", "ts_ms div 3600000")
    return wire.okx_open_interest(f)


@query("wire_binance_oi_hist", f"{T} SELECT 'binance' AS exchange, exchange AS symbol, ts_ms, 'oi_sum_coin' AS metric, qty AS value FROM tape UNION ALL SELECT 'binance', exchange, ts_ms, 'oi_sum_usd', price FROM tape")
def binance_oi_hist(spark, d):
    f = frames(spark, d, "named_struct('symbol', exchange, 'timestamp', ts_ms, 'sumOpenInterest', cast(qty as string), 'sumOpenInterestValue', cast(price as string))", "{x}", "ts_ms div 3600000")
    return wire.binance_oi_hist(f, "EVT")
