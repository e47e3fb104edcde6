"""The terminal's tape and book operators: filters and tiers, journals, screens, trailing windows, detectors and alerts.

Rules that remember what they kept or fired pass one row from a chunk of time to the next (`windows.spaced`);
everything else is a window or an aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_week, size_tier, utc_day
from tidemark.functions.windows import by, nearest_rank, overlapped, previous, ratio, running_sums, spaced


def valid_trade() -> Column:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < math.inf)
    return ok("ts_ms") & ok("price") & ok("qty") & (F.col("price") > 0) & (F.col("qty") > 0)


def tape_rows(trades: DataFrame, venues: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Valid prints of the venues from a notional on, with notional and tier."""
    t = trades.filter(valid_trade()).withColumn("notional", F.col("price") * F.col("qty"))
    t = t.filter(F.col("notional") >= least)
    if venues:
        t = t.filter(F.col("exchange").isin(venues))
    return t.withColumn("tier", size_tier(F.col("notional")))


def tape_floor(trades: DataFrame, floor: float) -> DataFrame:
    """What a floor hides, by venue: prints and notional by side below it, and its share."""
    t = trades.filter(valid_trade()).withColumn("notional", F.col("price") * F.col("qty"))
    low, buy = F.col("notional") < floor, F.col("aggressor_buy")
    total = lambda c: F.sum(F.when(c, F.col("notional")).otherwise(0.0))
    return t.groupBy("exchange").agg(F.count(F.when(low, 1)).alias("prints"), total(low & buy).alias("buy"), total(low & ~buy).alias("sell"), ratio(total(low), F.sum("notional")).alias("share"))


#: Word lists of the news ladder; fixed.
COINS = r"\b(bitcoin|btc|ethereum|eth|solana|sol|crypto)\b"
PRESS = r"\b(coindesk|cointelegraph|the block|decrypt)\b"
KEYWORDS = r"\b(etf|stablecoin|defi|blockchain|halving|on-chain|mining)\b"
VENUES = r"\b(binance|coinbase|bybit|okx|deribit|kraken)\b"


def news_relevance(items: DataFrame) -> DataFrame:
    """Add why: the first kind of evidence found in title (and symbols), NULL if none."""
    text = F.lower(F.coalesce("title", F.lit("")))
    why = F.when(text.rlike(COINS), "coin").when(F.size(F.coalesce("symbols", F.array().cast("array<string>"))) > 0, "symbol").when(F.lower(F.coalesce("source", F.lit(""))).rlike(PRESS), "press").when(text.rlike(KEYWORDS), "keyword").when(text.rlike(VENUES), "venue")
    return items.withColumn("why", why)


def news_counts(items: DataFrame) -> DataFrame:
    r = news_relevance(items)
    return r.agg(F.count("*").alias("total"), F.count("why").alias("kept"), F.count(F.when(F.col("why").isNull(), 1)).alias("filtered"), F.count(F.when(F.lower("title").rlike(r"\b(bitcoin|btc)\b"), 1)).alias("btc"))


def journal_stats(journal: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Trades with an R (others counted as excluded): win rate, expectancy, SQN, profit factor, averages and deepest drawdown in R."""
    keys = keys or []
    r = F.col("r")
    w = Window.partitionBy(*keys).orderBy("ts_ms", "trade_id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = journal.withColumn("_c", F.sum(F.coalesce("r", F.lit(0.0))).over(run)).withColumn("_dd", F.col("_c") - F.greatest(F.max("_c").over(run), F.lit(0.0)))
    return d.groupBy(*keys).agg(
        F.count("r").alias("n"), F.count(F.when(r.isNull(), 1)).alias("excluded"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg("r").alias("expectancy"), (ratio(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.count("r"))).alias("sqn"),
        ratio(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"), F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"), F.min("_dd").alias("max_drawdown"),
    )


def calendar_returns(journal: DataFrame) -> DataFrame:
    """Sum of R by day, ISO week, month and hour of day, in one pass of grouping sets."""
    d = journal.select("r", utc_day(F.col("ts_ms")).alias("day"), iso_week(F.col("ts_ms")).alias("week"), F.substring(utc_day(F.col("ts_ms")), 1, 7).alias("month"), F.format_string("%02d", F.floor(F.pmod("ts_ms", F.lit(86_400_000)) / 3_600_000)).alias("hour"))
    g = d.groupingSets([["day"], ["week"], ["month"], ["hour"]], "day", "week", "month", "hour").agg(F.sum("r").alias("r"), F.count("r").alias("n"))
    kind = F.when(F.col("day").isNotNull(), "day").when(F.col("week").isNotNull(), "week").when(F.col("month").isNotNull(), "month").otherwise("hour")
    return g.select(kind.alias("kind"), F.coalesce("day", "week", "month", "hour").alias("key"), "r", "n")


def screener(tickers: DataFrame, n: int) -> DataFrame:
    return tickers.orderBy(F.desc_nulls_last("turnover"), "symbol").limit(n)


def cvd(trades: DataFrame) -> DataFrame:
    """Running signed notional, in all and by size, at each print."""
    x = F.when(F.col("aggressor_buy"), 1.0).otherwise(-1.0) * F.col("price") * F.col("qty")
    tier = size_tier(F.col("price") * F.col("qty"))
    sums = {"cvd": x} | {f"cvd_{k}": F.when(tier == k, x).otherwise(0.0) for k in range(4)}
    return running_sums(trades, sums, ["exchange"]).select("exchange", "ts_ms", "trade_id", *sums)


def intensity(trades: DataFrame, short_ms: int, long_ms: int) -> DataFrame:
    """At each print: prints and notional a second over two trailing windows (now - w, now], and the short rate's z against the completed short buckets before."""
    v = F.col("price") * F.col("qty")
    w = Window.partitionBy("exchange", "_chunk").orderBy("ts_ms")
    t = overlapped(trades, max(short_ms, long_ms))
    for name, ms in (("short", short_ms), ("long", long_ms)):
        frame = w.rangeBetween(-(ms - 1), 0)
        t = t.withColumns({f"rate_{name}": F.count("*").over(frame) * 1000.0 / ms, f"notional_{name}": F.sum(v).over(frame) * 1000.0 / ms})
    bucket = F.floor(F.col("ts_ms") / short_ms).cast("long")
    counts = trades.groupBy("exchange", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    past = Window.partitionBy("exchange").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("exchange", "bucket", F.avg("n").over(past).alias("_m"), F.stddev_samp("n").over(past).alias("_s"))
    t = t.filter("_own").drop("_own", "_chunk").withColumn("bucket", bucket).join(counts, ["exchange", "bucket"])
    return t.withColumn("z", ratio(F.col("rate_short") * short_ms / 1000 - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def trailing_by_level(trades: DataFrame, ms: int, tick: float) -> DataFrame:
    """Bought and sold quantity at a print's level over the trailing window."""
    t = overlapped(trades.withColumn("level", F.floor(F.round(F.col("price") / tick, 9)).cast("long")), ms)
    w = Window.partitionBy("exchange", "level", "_chunk").orderBy("ts_ms").rangeBetween(-(ms - 1), 0)
    t = t.withColumns({"buy": F.sum(F.when(F.col("aggressor_buy"), F.col("qty")).otherwise(0.0)).over(w), "sell": F.sum(F.when(~F.col("aggressor_buy"), F.col("qty")).otherwise(0.0)).over(w)})
    return t.filter("_own").drop("_own", "_chunk")


def trailing_sum(events: DataFrame, value: str, ms: int, name: str, keys: tuple[str, ...] = ("exchange",)) -> DataFrame:
    """Add name: the sum of value over (now - ms, now] at each event, like the notional liquidated in the last minutes."""
    w = Window.partitionBy(*keys, "_chunk").orderBy("ts_ms").rangeBetween(-(ms - 1), 0)
    return overlapped(events, ms).withColumn(name, F.sum(value).over(w)).filter("_own").drop("_own", "_chunk")


def leg_cvd(trades: DataFrame, perps: list[str], sample_ms: int) -> DataFrame:
    """Running signed notional of perpetual and spot venues at the end of each closed bucket with prints; the newest bucket is still open and left out."""
    x = F.when(F.col("aggressor_buy"), 1.0).otherwise(-1.0) * F.col("price") * F.col("qty")
    perp = F.col("exchange").isin(perps)
    g = trades.filter(x != 0).groupBy((F.floor(F.col("ts_ms") / sample_ms) * sample_ms).cast("long").alias("ts_ms")).agg(F.sum(F.when(perp, x).otherwise(0.0)).alias("_p"), F.sum(F.when(~perp, x).otherwise(0.0)).alias("_s"))
    g = running_sums(g, {"cvd_perp": F.col("_p"), "cvd_spot": F.col("_s")}, [], ties=())
    newest = g.agg(F.max("ts_ms").alias("_end"))
    return g.join(F.broadcast(newest), F.col("ts_ms") < F.col("_end")).select("ts_ms", "cvd_perp", "cvd_spot")  # one row


def last_prints(trades: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """The newest n prints from a notional on."""
    return trades.filter(F.col("price") * F.col("qty") >= least).orderBy(F.desc("ts_ms"), F.desc("trade_id")).limit(n)


def trade_circles(trades: DataFrame, most: float = 3.0) -> DataFrame:
    """Add size: root of notional over its nearest-rank 95th percentile, capped."""
    v = F.col("price") * F.col("qty")
    p95 = nearest_rank(trades.select("exchange", v.alias("v")), "v", 0.95, ["exchange"], "p95")
    return trades.join(F.broadcast(p95), "exchange").withColumn("size", F.least(F.sqrt(F.coalesce(F.try_divide(v, F.col("p95")), F.lit(0.0))), F.lit(most)))  # one row for each venue


def opening_type(bars: DataFrame, minutes: int) -> DataFrame:
    """The first bars of each day: drive (never back through the open), test_drive (one excursion against, then away), rejection_reverse (the far side is taken back) or auction."""
    w = Window.partitionBy("exchange", "day").orderBy("bar")
    d = bars.withColumns({"_i": F.row_number().over(w), "_o": F.first("open").over(w)}).filter(F.col("_i") <= minutes)
    side = F.signum(F.col("close") - F.col("_o"))
    d = d.withColumns({"_s": side, "_x": (side * F.lag(side).over(w) < 0).cast("int")})
    g = d.groupBy("exchange", "day").agg(F.count("*").alias("n"), F.sum("_x").alias("crossings"), F.max_by("_s", "bar").alias("last"), F.first("_o").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"))
    up, down = F.col("high") - F.col("open"), F.col("open") - F.col("low")
    against = F.when(F.col("last") > 0, down).otherwise(up)
    along = F.when(F.col("last") > 0, up).otherwise(down)
    kind = F.when(F.col("n") < minutes, "pending").when((F.coalesce("crossings", F.lit(0)) == 0) & (against <= 0.1 * along), "drive").when((F.coalesce("crossings", F.lit(0)) <= 1) & (against <= 0.5 * along), "test_drive").when(F.coalesce("crossings", F.lit(0)) <= 1, "rejection_reverse").otherwise("auction")
    return g.select("exchange", "day", "n", kind.alias("kind"))


def absorption(prints: DataFrame, bars: DataFrame, times: float = 3.0) -> DataFrame:
    """Levels with at least `times` a bar's median volume whose side made no progress in the next bar. prints: exchange, bar, level, buy, sell; bars: exchange, bar, high, low."""
    v = F.col("buy") + F.col("sell")
    med = prints.groupBy("exchange", "bar").agg(F.percentile(v, F.lit(0.5)).alias("_m"))
    w = by("exchange", "bar")
    ahead = bars.select("exchange", "bar", (F.lead("high").over(w) <= F.col("high")).alias("_no_high"), (F.lead("low").over(w) >= F.col("low")).alias("_no_low"))
    d = prints.join(med, ["exchange", "bar"]).join(ahead, ["exchange", "bar"]).filter(v >= times * F.col("_m"))
    return d.filter(F.when(F.col("buy") >= F.col("sell"), F.col("_no_high")).otherwise(F.col("_no_low"))).select("exchange", "bar", "level", F.when(F.col("buy") >= F.col("sell"), "buy").otherwise("sell").alias("side"), v.alias("volume"))


# -- rules that remember what they kept or fired


def downsample(df: DataFrame, ms: int) -> DataFrame:
    """Rows at least ms after the last one that was kept (which is no tumbling window)."""
    return spaced(df.select("exchange", "ts_ms", "trade_id"), ms, ["exchange"]).filter("kept").select("exchange", "ts_ms", "trade_id")


def blocks(trades: DataFrame, ms: int) -> DataFrame:
    """Consecutive prints of one side and price within ms of their block's first print, as one."""
    t = trades.select("exchange", "ts_ms", "trade_id", "price", "qty", "aggressor_buy").withColumn("_is", F.struct("aggressor_buy", "price"))
    t = previous(t, "_was", "_is", ["exchange"], ties=("trade_id",)).withColumn("_turn", ~F.col("_was").eqNullSafe(F.col("_is"))).drop("_is", "_was")
    d = spaced(t, ms + 1, ["exchange"], "_turn")
    g = d.groupBy("exchange", F.col("start_ms").alias("ts_ms"), "start_id", "price", "aggressor_buy").agg(F.sum("qty").alias("qty"), F.count("*").alias("prints"))
    return g.select("exchange", "ts_ms", "price", "aggressor_buy", "qty", "prints")


def volume_clock(trades: DataFrame, volume: float) -> DataFrame:
    """Buckets of a fixed volume from the first print on (not anchored by day): close time and imbalance. Only sums meet, so no fold is needed."""
    t = running_sums(trades.filter("qty > 0"), {"c1": F.col("qty")}, ["exchange"]).withColumn("c0", F.col("c1") - F.col("qty"))
    first, last = F.floor(F.col("c0") / volume).cast("long"), (F.ceil(F.col("c1") / volume) - 1).cast("long")
    t = t.withColumn("k", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn("part", F.least("c1", (F.col("k") + 1) * volume) - F.greatest("c0", F.col("k") * volume)).filter("part > 0")
    side = F.when(F.col("aggressor_buy"), F.col("part")).otherwise(-F.col("part"))
    return t.groupBy("exchange", "k").agg(F.max("ts_ms").alias("close_ms"), F.sum("part").alias("_v"), (F.abs(F.sum(side)) / volume).alias("imbalance")).filter(F.col("_v") >= volume * (1 - 1e-9)).drop("_v")


def alerts(df: DataFrame, rule: str, level: float, cooldown_ms: int, value: str = "price") -> DataFrame:
    """Times at which a rule fires, no sooner than cooldown_ms after it fired last: above, below, cross_up, cross_down, change (of at least level against the row before, as a share)."""

    x, before = F.col(value), F.col("_before")
    d = previous(df.select("exchange", "ts_ms", "trade_id", value), "_before", value, ["exchange"], ties=("trade_id",))
    hit = {"above": x > level, "below": x < level, "cross_up": (before <= level) & (x > level), "cross_down": (before >= level) & (x < level), "change": F.abs(F.try_divide(x, before) - 1) >= level}[rule]
    return spaced(d.filter(hit).drop("_before"), cooldown_ms, ["exchange"]).filter("kept").select("exchange", "ts_ms", value)


def sampled_corr(df: DataFrame, ms: int) -> DataFrame:
    """Correlation of two venues' log returns on a grid of ms, every pair of venues."""
    s = df.groupBy("exchange", F.floor(F.col("ts_ms") / ms).cast("long").alias("k")).agg(F.max_by("price", F.struct("ts_ms", "trade_id")).alias("p"))
    w = by("exchange", "k")
    r = s.withColumn("r", F.when((F.col("p") > 0) & (F.lag("p").over(w) > 0) & (F.lag("k").over(w) == F.col("k") - 1), F.log(F.col("p") / F.lag("p").over(w)))).filter("r is not null")
    a, b = (r.select("k", F.col("exchange").alias(e), F.col("r").alias(x)) for e, x in (("a", "x"), ("b", "y")))
    return a.join(b, "k").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.greatest(F.least(F.corr("x", "y"), F.lit(1.0)), F.lit(-1.0))).alias("r"))


def walls(levels: DataFrame, times: float, least: int) -> DataFrame:
    """Book levels (exchange, ts_ms, side, price, qty) at least `times` their snapshot's nearest-rank 95th percentile for `least` snapshots running: first and last seen, and how it ended (standing, or gone). A gaps-and-islands query over snapshot numbers."""
    snaps = levels.select("exchange", "ts_ms").distinct().withColumn("no", F.row_number().over(by("exchange", "ts_ms")))
    p95 = levels.groupBy("exchange", "ts_ms").agg(F.sort_array(F.collect_list("qty")).alias("_q")).select("exchange", "ts_ms", F.element_at("_q", F.greatest(F.ceil(0.95 * F.size("_q")), F.lit(1)).cast("int")).alias("_p"))
    d = levels.join(p95, ["exchange", "ts_ms"]).filter(F.col("qty") >= times * F.col("_p")).join(snaps, ["exchange", "ts_ms"])
    d = d.withColumn("_g", F.col("no") - F.row_number().over(Window.partitionBy("exchange", "side", "price").orderBy("no")))
    end = snaps.groupBy("exchange").agg(F.max("no").alias("_end"))
    g = d.groupBy("exchange", "side", "price", "_g").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"), F.max("qty").alias("qty"), F.max("no").alias("_last")).filter(F.col("n") >= least)
    return g.join(F.broadcast(end), "exchange").withColumn("state", F.when(F.col("_last") == F.col("_end"), "standing").otherwise("gone")).drop("_g", "_last", "_end")


def confluence(reads: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """For each row, each named column read as bull (at or above the second bound), bear (at or below the first) or flat, and the tally."""
    read = {f"{c}_read": F.when(F.col(c) >= hi, 1).when(F.col(c) <= lo, -1).when(F.col(c).isNotNull(), 0) for c, (lo, hi) in rules.items()}
    total = lambda v: sum((F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c in read), F.lit(0))
    return reads.withColumns(read).withColumns({"bull": total(1), "bear": total(-1), "known": sum((F.col(c).isNotNull().cast("int") for c in read), F.lit(0))})
