"""Schemas of the tick store and adapters that map the star-schema tables onto them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _struct(ddl: str) -> T.StructType:
    """StructType.fromDDL needs a running session; importing this module must not."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


#: Column names and order are the tick store's format.
TABLES: dict[str, T.StructType] = {
    name: _struct(ddl)
    for name, ddl in {
        "trades": "exchange string, symbol string, trade_id string, ts_ms bigint, price double, qty double, aggressor_buy boolean",
        "liquidations": "exchange string, symbol string, ts_ms bigint, side string, price double, qty double, notional_usd double",
        "depth_snapshots": "exchange string, symbol string, ts_ms bigint, bids string, asks string",
        "funding_mark": "exchange string, symbol string, ts_ms bigint, funding_rate double, next_funding_ts bigint, mark_price double, index_price double",
        "open_interest": "exchange string, symbol string, ts_ms bigint, oi double, oi_value double",
        "crowding": "exchange string, symbol string, ts_ms bigint, metric string, value double",
        "dvol": "exchange string, symbol string, ts_ms bigint, dvol double",
        "options_chain": "exchange string, symbol string, ts_ms bigint, expiry_ts bigint, strike double, cp string, mark_iv double, open_interest double, volume double, underlying_price double",
    }.items()
}
#: Key whose repetition a store refuses; tables without one keep every row.
UNIQUE = {"trades": ("exchange", "symbol", "trade_id")}
DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, floored; the session's zone plays no part."""
    day = F.unix_date(F.to_date(ts)).cast("long") * DAY_MS
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.date_part(F.lit("SECOND"), ts).cast("double") * 1000 + 1e-6).cast("long")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades: the type is the venue, the value the price, props.k the size."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("exchange"), F.lit("EVT").alias("symbol"), F.col("event_id").cast("string").alias("trade_id"), epoch_ms(F.col("ts")).alias("ts_ms"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"), (F.col("user_id") % 2 == 0).alias("aggressor_buy"),
    )


TAPE_SQL = """tape AS (SELECT event_type AS exchange, 'EVT' AS symbol, CAST(event_id AS VARCHAR) AS trade_id, epoch_us(ts) // 1000 AS ts_ms,
    value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, user_id % 2 = 0 AS aggressor_buy FROM events)"""


def ship_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades whose id may repeat."""
    i = read(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_returnflag").alias("exchange"), F.lit("SHIP").alias("symbol"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trade_id"), epoch_ms(F.col("l_shipdate")).alias("ts_ms"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") + 1e-7, 4).alias("price"), F.col("l_quantity").alias("qty"), (F.col("l_linestatus") == "O").alias("aggressor_buy"),
    )


SHIP_SQL = """ship AS (SELECT l_returnflag AS exchange, 'SHIP' AS symbol, concat_ws('-', l_orderkey, l_linenumber) AS trade_id, epoch_us(l_shipdate) // 1000 AS ts_ms,
    round(l_extendedprice / l_quantity + 1e-7, 4) AS price, l_quantity AS qty, l_linestatus = 'O' AS aggressor_buy FROM lineitem)"""


def daily(spark: SparkSession, sf_dir: str, by_priority: bool = False) -> DataFrame:
    """orders as daily bars: series, day, open, high, low, close, volume."""
    o = read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")).withColumn("series", F.col("o_orderpriority") if by_priority else F.lit("ALL"))
    order = F.struct("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice")
    return o.groupBy("series", "day").agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").cast("double").alias("volume"),
    )


def daily_sql(by_priority: bool = False) -> str:
    series = "o_orderpriority" if by_priority else "'ALL'"
    return f"""daily AS (SELECT series, day, first(p ORDER BY o_orderdate, o_orderkey) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY o_orderdate, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM (SELECT {series} AS series, CAST(o_orderdate AS DATE) AS day, o_totalprice AS p, o_orderdate, o_orderkey FROM orders) GROUP BY 1, 2)"""


def book(spark: SparkSession, sf_dir: str, levels: int = 16) -> DataFrame:
    """embeddings as depth snapshots with JSON ladders, best first."""
    e = read(spark, sf_dir, "embeddings")

    def ladder(first: int, price):
        side = F.transform(F.slice("embedding", first + 1, levels), lambda x, i: F.array(price(i.cast("double")), F.round(F.abs(x.cast("double")) + 0.01, 6)))
        return F.to_json(side)

    return e.select(
        F.col("label").cast("string").alias("exchange"), F.lit("EMB").alias("symbol"), (F.col("vec_id") * 1000).alias("ts_ms"),
        ladder(0, lambda i: 100 - 0.5 * i).alias("bids"), ladder(levels, lambda i: 100.5 + 0.5 * i).alias("asks"),
    )


def book_sql(levels: int = 16) -> str:
    side = lambda first, price: f"[[{price}, round(abs(CAST(embedding[{first} + i] AS DOUBLE)) + 0.01, 6)] for i in range(1, {levels + 1})]"
    return f"""book AS (SELECT CAST(label AS VARCHAR) AS exchange, 'EMB' AS symbol, vec_id * 1000 AS ts_ms, {side(0, "100 - 0.5 * (i - 1)")} AS bids, {side(levels, "100.5 + 0.5 * (i - 1)")} AS asks FROM embeddings)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as an option chain: strike, opt_type, iv, expiry (days), oi, underlying."""
    p, i = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    oi = i.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("oi"))
    kinds = F.pmod(F.length("p_type"), F.lit(4)) + 1
    return p.join(oi, "p_partkey", "left").select(
        "p_partkey", F.round("p_retailprice", 2).alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P").alias("opt_type"), (F.col("p_size") / 100.0).alias("iv"),
        (kinds * 30).alias("expiry_days"), F.coalesce("oi", F.lit(0.0)).alias("oi"),
    )


CHAIN_SQL = """chain AS (SELECT p_partkey, round(p_retailprice, 2) AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS opt_type, p_size / 100.0 AS iv,
    (length(p_type) % 4 + 1) * 30 AS expiry_days, coalesce(oi, 0.0) AS oi FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS oi FROM lineitem GROUP BY 1) i ON p_partkey = l_partkey)"""
