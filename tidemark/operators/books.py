"""Order-book snapshots as arrays: mid, microprice, imbalance, depth slope, order-flow imbalance, book walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import ratio
from tidemark.operators.bars import bar_of
from tidemark.sources.schemas import DAY_MS

LADDER = "array<array<double>>"


def parsed(snapshots: DataFrame) -> DataFrame:
    """Ladders as arrays of [price, qty], one row for each (exchange, symbol, ts_ms)."""
    s = snapshots.withColumns({c: F.from_json(c, LADDER) for c in ("bids", "asks")}).filter((F.size("bids") > 0) & (F.size("asks") > 0))
    w = Window.partitionBy("exchange", "symbol", "ts_ms").orderBy("bids", "asks")
    return s.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _qty(side: str, n: int) -> Column:
    return F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda a, x: a + x[1])


def depth_slope(side: str, mid: Column, n: int) -> Column:
    """Through-origin regression of cumulative quantity on the distance from mid in basis points."""
    start = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"))

    def step(a: Column, x: Column) -> Column:
        q, d = a["q"] + x[1], F.abs(x[0] - mid) / mid * 10_000
        return F.struct(q.alias("q"), (a["xy"] + d * q).alias("xy"), (a["xx"] + d * d).alias("xx"))

    return F.aggregate(F.slice(side, 1, n), start, step, lambda a: ratio(a["xy"], a["xx"]))


def book_features(snapshots: DataFrame, n: int = 10) -> DataFrame:
    """mid, spread, spread_bps, microprice, imbalance (the best bid's share of both best quantities), depth and slope of both sides (NULL for a side of fewer than n levels)."""
    s = parsed(snapshots)
    bp, bq, ap, aq = (F.get(F.get(side, F.lit(0)), F.lit(k)) for side in ("bids", "asks") for k in (0, 1))
    mid = (bp + ap) / 2
    s = s.withColumns({"bid": bp, "bid_qty": bq, "ask": ap, "ask_qty": aq, "mid": mid, "spread": ap - bp, "bid_depth": F.when(F.size("bids") >= n, _qty("bids", n)), "ask_depth": F.when(F.size("asks") >= n, _qty("asks", n))})
    return s.withColumns({
        "spread_bps": ratio(F.col("spread"), F.col("mid")) * 10_000,
        "microprice": ratio(F.col("bid") * F.col("ask_qty") + F.col("ask") * F.col("bid_qty"), F.col("bid_qty") + F.col("ask_qty")),
        "imbalance": ratio(F.col("bid_qty"), F.col("bid_qty") + F.col("ask_qty")),
        "bid_slope": F.when(F.size("bids") >= n, depth_slope("bids", F.col("mid"), n)), "ask_slope": F.when(F.size("asks") >= n, depth_slope("asks", F.col("mid"), n)),
    })


def ofi(features: DataFrame, gap_ms: int) -> DataFrame:
    """Add ofi against the snapshot before on the same UTC day, NULL across a gap longer than gap_ms, and pair_ms, the time between them."""
    features = features.withColumn("_day", bar_of("ts_ms", DAY_MS))
    w = Window.partitionBy("exchange", "symbol", "_day").orderBy("ts_ms")
    b = {c: F.lag(c).over(w) for c in ("bid", "bid_qty", "ask", "ask_qty", "ts_ms")}
    value = (
        F.when(F.col("bid") >= b["bid"], F.col("bid_qty")).otherwise(0.0) - F.when(F.col("bid") <= b["bid"], b["bid_qty"]).otherwise(0.0)
        - F.when(F.col("ask") <= b["ask"], F.col("ask_qty")).otherwise(0.0) + F.when(F.col("ask") >= b["ask"], b["ask_qty"]).otherwise(0.0)
    )
    return features.withColumns({"ofi": F.when(F.col("ts_ms") - b["ts_ms"] <= gap_ms, value), "pair_ms": F.col("ts_ms") - b["ts_ms"]}).drop("_day")


def book_bars(snapshots: DataFrame, bar_ms: int, gap_ms: int, n: int = 10) -> DataFrame:
    """The last state of each bar, its summed ofi (NULL without pairs), the pairs in it and those it leaves out for a gap."""
    f = ofi(book_features(snapshots, n), gap_ms)
    last = [F.max_by(c, "ts_ms").alias(c) for c in ("mid", "spread_bps", "microprice", "imbalance", "bid_depth", "ask_depth", "bid_slope", "ask_slope")]
    return f.groupBy("exchange", bar_of("ts_ms", bar_ms).alias("bar")).agg(*last, F.sum("ofi").alias("ofi"), F.count("ofi").alias("ofi_n"), F.count(F.when(F.col("pair_ms") > gap_ms, 1)).alias("ofi_gap_pairs"), F.count("*").alias("snapshots"))


def walk_price(side: str, notional: float) -> Column:
    """Average price to fill a notional from the ladder; NULL if it is too thin."""
    start = F.struct(F.lit(0.0).alias("qty"), F.lit(float(notional)).alias("left"))

    def step(a: Column, x: Column) -> Column:
        take = F.least(a["left"], x[0] * x[1])
        return F.struct((a["qty"] + take / x[0]).alias("qty"), (a["left"] - take).alias("left"))

    return F.aggregate(side, start, step, lambda a: F.when(a["left"] <= 1e-9, notional / a["qty"]))


def book_walk(snapshots: DataFrame, notional: float) -> DataFrame:
    """Impact beyond half the spread, in basis points, of buying and selling a notional."""
    f = book_features(snapshots).withColumns({"buy_px": walk_price("asks", notional), "sell_px": walk_price("bids", notional)})
    half = F.col("spread") / 2
    return f.withColumns({"buy_impact_bps": (F.col("buy_px") - F.col("mid") - half) / F.col("mid") * 10_000, "sell_impact_bps": (F.col("mid") - F.col("sell_px") - half) / F.col("mid") * 10_000})


def depth_imbalance(side_bids: str, side_asks: str, mid: Column, ticks: float) -> Column:
    """Share of bids minus asks among the quantity within `ticks` of mid."""
    near = lambda side: F.aggregate(F.filter(side, lambda x: F.abs(x[0] - mid) <= ticks), F.lit(0.0), lambda a, x: a + x[1])
    b, a = near(side_bids), near(side_asks)
    return ratio(b - a, b + a)


def ladder_rows(snapshots: DataFrame, tick: float, rows: int) -> DataFrame:
    """Both sides grouped to a tick (bids down, asks up) with running quantity and ticks from mid, the nearest rows first."""
    from tidemark.functions.scalars import snap

    f = book_features(snapshots).select("exchange", "ts_ms", "mid", F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.col("bids").alias("l")), F.struct(F.lit("ask").alias("side"), F.col("asks").alias("l")))).alias("s"))
    f = f.select("exchange", "ts_ms", "mid", "s.side", F.explode("s.l").alias("x")).withColumns({"price": F.when(F.col("side") == "bid", snap(F.col("x")[0], tick)).otherwise(snap(F.col("x")[0], tick, True)), "q": F.col("x")[1]})
    g = f.groupBy("exchange", "ts_ms", "side", "price").agg(F.sum("q").alias("qty"), F.max("mid").alias("mid"))
    away = F.abs(F.col("price") - F.col("mid"))
    w = Window.partitionBy("exchange", "ts_ms", "side").orderBy(away)
    return g.withColumns({"row": F.row_number().over(w), "total": F.sum("qty").over(w.rowsBetween(Window.unboundedPreceding, 0)), "ticks": F.round(away / tick, 6)}).filter(F.col("row") <= rows)


def depth_velocity(snapshots: DataFrame, tick: float, rows: int, window_ms: int) -> DataFrame:
    """Change of the quantity resting at each price bucket, a second, from the oldest to the newest snapshot of the window that ends at a venue's newest.

    A bucket that one of the two lacks holds 0 there; 0 also where the window has one snapshot only.
    """
    times = snapshots.groupBy("exchange").agg(F.max("ts_ms").alias("_last"))
    near = snapshots.join(times, "exchange").filter(F.col("ts_ms") >= F.col("_last") - window_ms)
    ends = near.groupBy("exchange").agg(F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last"))
    two = snapshots.join(ends, "exchange").filter(F.col("ts_ms").isin(F.col("_first"), F.col("_last")))
    at = ladder_rows(two.drop("_first", "_last"), tick, rows).join(ends, "exchange")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("ts_ms") == F.col(c), F.col("qty"))), F.lit(0.0))
    g = at.groupBy("exchange", "price").agg(total("_last").alias("qty"), total("_first").alias("_was"), ((F.max("_last") - F.max("_first")) / 1000).alias("_s"))
    return g.select("exchange", "price", "qty", F.coalesce(ratio(F.col("qty") - F.col("_was"), F.col("_s")), F.lit(0.0)).alias("velocity"))


def depth_range(snapshots: DataFrame, tick: float, rows: int) -> DataFrame:
    """Lowest and highest price bucket of each snapshot."""
    return ladder_rows(snapshots, tick, rows).groupBy("exchange", "ts_ms").agg(F.min("price").alias("low"), F.max("price").alias("high"))


def merged_book(snapshots: DataFrame, tick: float, top: int = 10) -> DataFrame:
    """Several venues' books at one instant: each cut to its best `top` levels, then added up by price with a venue map."""
    f = parsed(snapshots).select("exchange", "ts_ms", F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.slice("bids", 1, top).alias("l")), F.struct(F.lit("ask").alias("side"), F.slice("asks", 1, top).alias("l")))).alias("s"))
    f = f.select("exchange", "ts_ms", "s.side", F.explode("s.l").alias("x")).select("exchange", "ts_ms", "side", (F.round(F.col("x")[0] / tick) * tick).alias("price"), F.col("x")[1].alias("q"))
    f = f.groupBy("ts_ms", "side", "price", "exchange").agg(F.sum("q").alias("q"))
    return f.groupBy("ts_ms", "side", "price").agg(F.sum("q").alias("qty"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("exchange", "q")))).alias("by_exchange"))
