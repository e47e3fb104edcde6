"""Wire frames to tick rows: one projection for each venue message, from JSON text in column `frame`.

Numbers on the wire may be strings; what does not parse becomes NULL and, where a row needs it, the row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.options import parse_instrument

#: Contract size of the venue that quotes in contracts; fixed.
CONTRACT = 0.01
LEVELS = "array<array<string>>"


def num(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).try_cast("double")


def whole(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).try_cast("bigint")


def parse(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("f", F.from_json("frame", schema))


def _entries(df: DataFrame) -> DataFrame:
    """One map for each entry of data: its keys differ by case only, which field names of a struct may not."""
    return df.select(F.explode(F.from_json("frame", "struct<data:array<map<string,string>>>")["data"]).alias("x"))


def bybit_trades(df: DataFrame) -> DataFrame:
    x = F.col("x")
    return _entries(df).select(F.lit("bybit").alias("exchange"), x["s"].alias("symbol"), x["i"].alias("trade_id"), whole(x["T"]).alias("ts_ms"), num(x["p"]).alias("price"), num(x["v"]).alias("qty"), (x["S"] == "Buy").alias("aggressor_buy"))


def bybit_liquidations(df: DataFrame) -> DataFrame:
    """A buy print closes a short."""
    x = F.col("x")
    price, qty = num(x["p"]), num(x["v"])
    return _entries(df).select(F.lit("bybit").alias("exchange"), x["s"].alias("symbol"), whole(x["T"]).alias("ts_ms"), F.when(x["S"] == "Buy", "short").otherwise("long").alias("side"), price.alias("price"), qty.alias("qty"), (price * qty).alias("notional_usd"))


def bybit_tickers(df: DataFrame) -> DataFrame:
    """Snapshots and deltas merged by carrying the last value of each field; rows only once all are known."""
    d = parse(df, "type string, ts bigint, data struct<symbol:string,fundingRate:string,nextFundingTime:string,markPrice:string,indexPrice:string,openInterest:string>").select("f.type", F.col("f.ts").alias("ts_ms"), "f.data.*")
    own = Window.partitionBy("symbol").orderBy("ts_ms")
    d = d.withColumn("_epoch", F.sum((F.col("type") == "snapshot").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("symbol", "_epoch").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    fields = ("fundingRate", "nextFundingTime", "markPrice", "indexPrice", "openInterest")
    d = d.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in fields}).dropna(subset=list(fields))
    return d.select(F.lit("bybit").alias("exchange"), "symbol", "ts_ms", num("fundingRate").alias("funding_rate"), whole("nextFundingTime").alias("next_funding_ts"), num("markPrice").alias("mark_price"), num("indexPrice").alias("index_price"), num("openInterest").alias("oi"))


def ladder(x: Column, descending: bool, scale: float = 1.0) -> Column:
    """Levels as numbers, best first, without empty ones."""
    level = F.filter(F.transform(x, lambda v: F.struct(num(v[0]).alias("p"), (num(v[1]) * scale).alias("q"))), lambda v: v["p"].isNotNull() & (v["q"] > 0))
    return F.transform(F.sort_array(level, not descending), lambda v: F.array(v["p"], v["q"]))


def binance_depth(df: DataFrame) -> DataFrame:
    d = parse(df, f"E bigint, s string, b {LEVELS}, a {LEVELS}")
    return d.select(F.lit("binance").alias("exchange"), F.col("f.s").alias("symbol"), F.col("f.E").alias("ts_ms"), F.to_json(ladder(F.col("f.b"), True)).alias("bids"), F.to_json(ladder(F.col("f.a"), False)).alias("asks"))


def binance_premium_index(df: DataFrame) -> DataFrame:
    d = parse(df, "symbol string, time bigint, lastFundingRate string, nextFundingTime bigint, markPrice string, indexPrice string").select("f.*")
    return d.select(F.lit("binance").alias("exchange"), "symbol", F.col("time").alias("ts_ms"), num("lastFundingRate").alias("funding_rate"), F.col("nextFundingTime").alias("next_funding_ts"), num("markPrice").alias("mark_price"), num("indexPrice").alias("index_price"))


def binance_open_interest(df: DataFrame) -> DataFrame:
    return parse(df, "symbol string, time bigint, openInterest string").select(F.lit("binance").alias("exchange"), F.col("f.symbol").alias("symbol"), F.col("f.time").alias("ts_ms"), num("f.openInterest").alias("oi"))


def binance_agg_trades(df: DataFrame, symbol: str) -> DataFrame:
    """The buyer as maker means that a seller struck. The next cursor is max(trade_id) + 1."""
    d = df.select(F.explode(F.from_json("frame", "array<struct<a:bigint,p:string,q:string,T:bigint,m:boolean>>")).alias("x"))
    return d.select(F.lit("binance").alias("exchange"), F.lit(symbol).alias("symbol"), F.col("x.a").cast("string").alias("trade_id"), F.col("x.T").alias("ts_ms"), num("x.p").alias("price"), num("x.q").alias("qty"), (~F.col("x.m")).alias("aggressor_buy"))


def binance_crowding(df: DataFrame, metrics: dict[str, str], symbol: str) -> DataFrame:
    """Long rows (metric, value) from a list of entries; metrics maps a field to a metric's name."""
    fields = ",".join(f"{f}:string" for f in metrics)
    d = df.select(F.explode(F.from_json("frame", f"array<struct<symbol:string,timestamp:bigint,{fields}>>")).alias("x"))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), num(F.col(f"x.{f}")).alias("value")) for f, m in metrics.items()])
    return d.select(F.lit("binance").alias("exchange"), F.coalesce("x.symbol", F.lit(symbol)).alias("symbol"), F.col("x.timestamp").alias("ts_ms"), F.explode(rows).alias("r")).select("exchange", "symbol", "ts_ms", "r.*").filter("value is not null")


def binance_oi_hist(df: DataFrame, symbol: str) -> DataFrame:
    """Open interest by period, in coins and in dollars, as two rows each: neither is derived from the other."""
    return binance_crowding(df, {"sumOpenInterest": "oi_sum_coin", "sumOpenInterestValue": "oi_sum_usd"}, symbol)


def okx_trades(df: DataFrame, contract: float = CONTRACT) -> DataFrame:
    d = parse(df, "data array<struct<instId:string,tradeId:string,px:string,sz:string,side:string,ts:string>>").select(F.explode("f.data").alias("x"))
    return d.select(F.lit("okx").alias("exchange"), F.col("x.instId").alias("symbol"), F.col("x.tradeId").alias("trade_id"), whole("x.ts").alias("ts_ms"), num("x.px").alias("price"), (num("x.sz") * contract).alias("qty"), (F.col("x.side") == "buy").alias("aggressor_buy"))


def okx_funding(df: DataFrame) -> DataFrame:
    """Mark and index are not on this message and stay NULL; an error code gives no rows."""
    d = parse(df, "code string, data array<struct<instId:string,ts:string,fundingRate:string,nextFundingTime:string>>").filter("f.code = '0'").select(F.explode("f.data").alias("x"))
    return d.select(F.lit("okx").alias("exchange"), F.col("x.instId").alias("symbol"), whole("x.ts").alias("ts_ms"), num("x.fundingRate").alias("funding_rate"), whole("x.nextFundingTime").alias("next_funding_ts"), F.lit(None).cast("double").alias("mark_price"), F.lit(None).cast("double").alias("index_price"))


def okx_open_interest(df: DataFrame) -> DataFrame:
    d = parse(df, "code string, data array<struct<instId:string,ts:string,oiCcy:string>>").filter("f.code = '0'").select(F.explode("f.data").alias("x"))
    return d.select(F.lit("okx").alias("exchange"), F.col("x.instId").alias("symbol"), whole("x.ts").alias("ts_ms"), num("x.oiCcy").alias("oi"))


def coinbase_trades(df: DataFrame) -> DataFrame:
    """side is the maker's: a maker that sold met a buyer. Only ids above all that came before (column seq) count."""
    d = df.select("seq", F.from_json("frame", "struct<trades:array<struct<trade_id:string,product_id:string,price:string,size:string,time:string,side:string>>>").alias("f")).select("seq", F.explode("f.trades").alias("x"))
    d = d.select("seq", F.lit("coinbase").alias("exchange"), F.col("x.product_id").alias("symbol"), F.col("x.trade_id").alias("trade_id"), F.unix_millis(F.try_to_timestamp("x.time")).alias("ts_ms"), num("x.price").alias("price"), num("x.size").alias("qty"), (F.upper("x.side") == "SELL").alias("aggressor_buy"), whole("x.trade_id").alias("_id"))
    top = d.groupBy("symbol", "seq").agg(F.max("_id").alias("_top"))
    before = F.max("_top").over(Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    d = d.join(top.select("symbol", "seq", before.alias("_before")), ["symbol", "seq"]).filter(F.col("_before").isNull() | (F.col("_id") > F.col("_before")))
    return d.dropDuplicates(["symbol", "trade_id"]).drop("_id", "_before", "seq")


def deribit_dvol(df: DataFrame) -> DataFrame:
    d = parse(df, "usOut bigint, result struct<index_name:string,volatility:double>, error string")
    return d.filter("f.error is null and f.result is not null").select(F.lit("deribit").alias("exchange"), F.col("f.result.index_name").alias("symbol"), F.floor(F.col("f.usOut") / 1000).cast("long").alias("ts_ms"), F.col("f.result.volatility").alias("dvol"))


def deribit_chain(df: DataFrame) -> DataFrame:
    """Chain rows; iv from percent; names that are no option are left out (count them with skipped())."""
    d = parse(df, "usOut bigint, result array<struct<instrument_name:string,mark_iv:double,open_interest:double,volume:double,underlying_price:double>>").select(F.floor(F.col("f.usOut") / 1000).cast("long").alias("ts_ms"), F.explode("f.result").alias("x"))
    d = d.withColumn("i", parse_instrument(F.col("x.instrument_name")))
    return d.filter("i is not null").select("ts_ms", F.col("x.instrument_name").alias("symbol"), F.col("i.expiry_ms").alias("expiry_ts"), F.col("i.strike").alias("strike"), F.col("i.opt_type").alias("cp"), (F.col("x.mark_iv") / 100).alias("mark_iv"), F.col("x.open_interest").alias("open_interest"), F.col("x.volume").alias("volume"), F.col("x.underlying_price").alias("underlying_price"))


def klines(df: DataFrame) -> DataFrame:
    """Lists of strings, newest first, to bars in time order (sort where it is used)."""
    d = parse(df, "result struct<symbol:string,list:array<array<string>>>").select(F.col("f.result.symbol").alias("series"), F.explode("f.result.list").alias("x"))
    return d.select("series", whole(F.col("x")[0]).alias("ts_ms"), *[num(F.col("x")[i]).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)]).dropna()


def ticker_vwap(df: DataFrame) -> DataFrame:
    """24 hour vwap (turnover over volume) and the last price's deviation from it."""
    d = parse(df, "result struct<list:array<struct<symbol:string,lastPrice:string,turnover24h:string,volume24h:string>>>").select(F.explode("f.result.list").alias("x"))
    vwap = F.try_divide(num("x.turnover24h"), num("x.volume24h"))
    return d.select(F.col("x.symbol").alias("symbol"), num("x.turnover24h").alias("turnover"), vwap.alias("vwap"), F.try_divide(num("x.lastPrice") - vwap, vwap).alias("deviation"))


def leaderboard(df: DataFrame, n: int) -> DataFrame:
    d = parse(df, "leaderboardRows array<struct<ethAddress:string,accountValue:string>>").select(F.explode("f.leaderboardRows").alias("x"))
    return d.select(F.col("x.ethAddress").alias("address"), num("x.accountValue").alias("value")).orderBy(F.desc_nulls_last("value"), "address").limit(n)


def positions(df: DataFrame) -> DataFrame:
    d = parse(df, "assetPositions array<struct<position:struct<coin:string,szi:string,entryPx:string,positionValue:string>>>").select(F.explode("f.assetPositions.position").alias("x"))
    size = num("x.szi")
    return d.select(F.col("x.coin").alias("symbol"), F.when(size >= 0, "long").otherwise("short").alias("side"), F.abs(size).alias("qty"), num("x.entryPx").alias("entry"), num("x.positionValue").alias("value"))


def mids(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.from_json("frame", "map<string,string>")).alias("symbol", "p")).select("symbol", num("p").alias("mid")).filter("mid is not null")


def prediction_events(df: DataFrame) -> DataFrame:
    """Markets of events whose outcomes and prices are JSON arrays inside strings."""
    d = df.select(F.explode(F.from_json("frame", "array<struct<title:string,markets:array<struct<question:string,outcomes:string,outcomePrices:string>>>>")).alias("e")).select("e.title", F.explode("e.markets").alias("m"))
    z = F.arrays_zip(F.from_json("m.outcomes", "array<string>").alias("o"), F.from_json("m.outcomePrices", "array<string>").alias("p"))
    return d.select("title", F.col("m.question").alias("question"), F.explode(z).alias("z")).select("title", "question", F.col("z.o").alias("outcome"), num("z.p").alias("probability"))


def news(df: DataFrame) -> DataFrame:
    d = df.select(F.from_json("frame", "struct<_id:string,time:bigint,title:string,source:string,symbols:array<string>>").alias("f")).select("f.*")
    return d.select(F.col("_id").alias("id"), F.col("time").alias("ts_ms"), "title", "source", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


def calendar(df: DataFrame) -> DataFrame:
    d = df.select(F.explode(F.from_json("frame", "array<struct<title:string,country:string,date:string,impact:string,forecast:string,previous:string>>")).alias("x")).select("x.*")
    return d.select("title", "country", F.unix_millis(F.try_to_timestamp("date")).alias("ts_ms"), "impact", "forecast", "previous")


def chain_rule(df: DataFrame) -> DataFrame:
    """Add verdict of depth diffs (ev_first first id, ev_u last id, ev_pu last id of the event before) against a snapshot's last id: drop_pre_snapshot, first_ok, ok or gap."""
    w = Window.partitionBy("symbol").orderBy("seq")
    prev = F.lag("ev_u").over(w)
    first = (F.col("ev_u") >= F.col("snapshot_last_id")) & (prev.isNull() | (prev < F.col("snapshot_last_id")))
    verdict = F.when(F.col("ev_u") < F.col("snapshot_last_id"), "drop_pre_snapshot").when(first, F.when(F.col("ev_first") <= F.col("snapshot_last_id"), "first_ok").otherwise("gap")).when(F.col("ev_pu") == prev, "ok").otherwise("gap")
    return df.withColumn("verdict", verdict)


def book_checksum(bids: Column, asks: Column, n: int = 25) -> Column:
    """Signed CRC-32 of the first n levels of both sides, alternating bid and ask as price:size. Levels are arrays of strings."""
    pair = F.zip_with(F.transform(F.slice(bids, 1, n), lambda x: F.concat_ws(":", x[0], x[1])), F.transform(F.slice(asks, 1, n), lambda x: F.concat_ws(":", x[0], x[1])), lambda a, b: F.concat_ws(":", a, b))
    return _signed(F.crc32(F.array_join(pair, ":").cast("binary")))


def _signed(x: Column) -> Column:
    return F.when(x >= 2**31, x - 2**32).otherwise(x).cast("long")
