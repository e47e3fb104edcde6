"""Volume profiles: levels, point of control and value area, time profiles, footprints, imbalances, naked levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import size_tier, snap
from tidemark.functions.windows import running_sums
from tidemark.operators.bars import TIERS, bar_of
from tidemark.operators.quality import first_of
from tidemark.sources.schemas import DAY_MS

AREA = 0.7


def profile(trades: DataFrame, tick: float, keys: list[str], dedup: bool = True) -> DataFrame:
    """Level (price rounded to the tick): buy, sell, prints, notional and volume by size, after dedup by trade_id."""
    t = first_of(trades, ["exchange", "symbol", "trade_id"], ["ts_ms", "price", "qty"]) if dedup else trades
    q = F.col("qty")
    tier = size_tier(F.col("price") * q)
    return t.withColumn("level", F.round(F.round(F.col("price") / tick) * tick, 9)).groupBy(*keys, "level").agg(
        F.sum(F.when(F.col("aggressor_buy"), q).otherwise(0.0)).alias("buy"), F.sum(F.when(~F.col("aggressor_buy"), q).otherwise(0.0)).alias("sell"), F.sum(q).alias("volume"), F.count("*").alias("prints"),
        F.sum(F.col("price") * q).alias("notional"), *[F.sum(F.when(tier == k, q).otherwise(0.0)).alias(f"vol_{t}") for k, t in enumerate(TIERS)],
    )


def value_area(levels: DataFrame, keys: list[str], area: float = AREA, level: str = "level", volume: str = "volume") -> DataFrame:
    """poc, vah, val of each key: from the first largest level, the larger neighbour joins (the upper one on a tie) until the area's share is inside.

    A fold over the sorted levels of one key; their number is bounded by the price range over the tick.
    """
    listed = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(level).alias("p"), F.col(volume).alias("v")))).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x["v"])
    top = F.array_max(F.transform("l", lambda x: x["v"]))
    listed = listed.withColumns({"_total": total, "_at": (F.array_position(F.transform("l", lambda x: x["v"]), top) - 1).cast("int")})
    at = lambda i: F.coalesce(F.get("l", i)["v"], F.lit(0.0))
    start = F.struct(F.col("_at").alias("lo"), F.col("_at").alias("hi"), at(F.col("_at")).alias("v"))

    def step(a: Column, _: Column) -> Column:
        up, down = at(a["hi"] + 1), F.when(a["lo"] > 0, at(F.greatest(a["lo"] - 1, F.lit(0)))).otherwise(F.lit(0.0))
        can_up, can_down = a["hi"] + 1 < F.size("l"), a["lo"] > 0
        done = (a["v"] >= area * F.col("_total") - 1e-9) | (~can_up & ~can_down)
        go_up = can_up & (~can_down | (up >= down))
        return F.when(done, a).when(go_up, F.struct(a["lo"].alias("lo"), (a["hi"] + 1).alias("hi"), (a["v"] + up).alias("v"))).otherwise(F.struct((a["lo"] - 1).alias("lo"), a["hi"].alias("hi"), (a["v"] + down).alias("v")))

    got = listed.withColumn("_a", F.aggregate(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(1))), start, step))
    price = lambda i: F.get("l", i)["p"]
    return got.select(*keys, price(F.col("_at")).alias("poc"), price(F.col("_a.hi")).alias("vah"), price(F.col("_a.lo")).alias("val"), F.col("_total").alias("volume"))


def day_levels(trades: DataFrame, tick: float) -> DataFrame:
    """exchange, day: modal symbol only, OHLC by time, volume, poc, vah, val."""
    t = trades.withColumn("day", bar_of("ts_ms", DAY_MS))
    modal = t.groupBy("exchange", "day", "symbol").count().groupBy("exchange", "day").agg(F.min_by("symbol", F.struct(-F.col("count"), F.col("symbol"))).alias("symbol"))
    t = first_of(t.join(modal, ["exchange", "day", "symbol"]), ["exchange", "day", "trade_id"], ["ts_ms", "price", "qty"])
    at = F.struct("ts_ms", "trade_id")
    ohlc = t.groupBy("exchange", "day").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"))
    return ohlc.join(value_area(profile(t, tick, ["exchange", "day"], dedup=False), ["exchange", "day"]), ["exchange", "day"])


def naked(levels: DataFrame) -> DataFrame:
    """Days whose poc lies in no later day's range; the highest low and lowest high ahead settle most, an anti join the rest."""
    later = levels.select(F.col("exchange").alias("e"), F.col("day").alias("later"), F.col("low").alias("l"), F.col("high").alias("h"))
    hit = (levels["exchange"] == F.col("e")) & (F.col("later") > levels["day"]) & (levels["poc"] >= F.col("l")) & (levels["poc"] <= F.col("h"))
    return levels.join(later, hit, "left_anti")


def vwap_sigma(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Volume-weighted mean price and deviation, in two passes (not by the difference of squares)."""
    v = trades.groupBy(*keys).agg(F.try_divide(F.sum(F.col("price") * F.col("qty")), F.sum("qty")).alias("vwap"), F.sum("qty").alias("volume"), F.count("*").alias("n"))
    dev = trades.join(v.select(*keys, "vwap"), keys).groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(F.col("qty") * (F.col("price") - F.col("vwap")) ** 2), F.sum("qty"))).alias("sigma"))
    return v.join(dev, keys)


def anchored_vwap(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Running vwap, sigma and bands from the first row of each key."""
    p, q = F.col("price"), F.col("qty")
    out = running_sums(trades, {"_q": q, "_pq": p * q, "_ppq": p**2 * q}, keys)
    out = out.withColumn("vwap", F.try_divide("_pq", "_q"))
    out = out.withColumn("sigma", F.sqrt(F.greatest(F.try_divide("_ppq", "_q") - F.col("vwap") ** 2, F.lit(0.0)))).drop("_q", "_pq", "_ppq")
    return out.withColumns({"upper": F.col("vwap") + 2 * F.col("sigma"), "lower": F.col("vwap") - 2 * F.col("sigma")})


def kline_profile(bars: DataFrame, buckets: int, keys: list[str]) -> DataFrame:
    """Bar volumes spread evenly over the price buckets that each bar's range touches; hv and lv mark nodes among two neighbours each way."""
    span = bars.groupBy(*keys).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    b = bars.join(span, keys).withColumn("_step", (F.col("_hi") - F.col("_lo")) / buckets).filter("_step > 0")
    of = lambda p: F.least(F.floor((F.col(p) - F.col("_lo")) / F.col("_step")), F.lit(buckets - 1)).cast("long")
    b = b.withColumns({"_a": of("low"), "_b": of("high")})
    b = b.withColumn("bucket", F.explode(F.sequence("_a", F.greatest("_a", "_b"))))
    g = b.groupBy(*keys, "bucket").agg(F.sum(F.col("volume") / (F.col("_b") - F.col("_a") + 1)).alias("volume"))
    med = g.groupBy(*keys).agg(F.percentile("volume", F.lit(0.5)).alias("_m"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    near = F.array_compact(F.array(*[F.lag("volume", k).over(w) for k in (2, 1, -1, -2)]))
    g = g.join(med, keys).withColumn("_near", near)
    edge = 0.25 * F.col("_m")
    return g.withColumns({"hv": F.col("volume") >= F.array_max("_near") + edge, "lv": F.col("volume") <= F.array_min("_near") - edge}).drop("_near", "_m")


def tpo(bars: DataFrame, tick: float, period_ms: int) -> DataFrame:
    """exchange, day, level, periods: the half hours (or period_ms) in which a day's bars touched each level. bars has ts_ms, high, low."""
    b = bars.withColumns({"day": bar_of("ts_ms", DAY_MS), "period": F.floor(F.pmod("ts_ms", F.lit(DAY_MS)) / period_ms).cast("int")})
    lo, hi = F.floor(F.col("low") / tick).cast("long"), F.floor(F.col("high") / tick).cast("long")
    b = b.withColumn("level", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    return b.groupBy("exchange", "day", "level").agg(F.sort_array(F.collect_set("period")).alias("periods"))


def tpo_summary(touched: DataFrame) -> DataFrame:
    """Of each day: point of control (most periods, nearest the middle, the lower on a tie), value area, single prints, initial balance and whether it was left."""
    n = F.size("periods")
    t = touched.withColumn("n", n.cast("double"))
    mid = t.groupBy("exchange", "day").agg(((F.min("level") + F.max("level")) / 2).alias("mid"), F.min(F.element_at("periods", 1)).alias("first"))
    t = t.join(mid, ["exchange", "day"])
    opening = F.exists("periods", lambda p: p <= F.col("first") + 1)
    g = t.groupBy("exchange", "day").agg(
        F.max_by("level", F.struct("n", -F.abs(F.col("level") - F.col("mid")), -F.col("level"))).alias("poc"), F.count(F.when(n == 1, 1)).alias("singles"),
        F.max(F.when(opening, F.col("level"))).alias("ib_high"), F.min(F.when(opening, F.col("level"))).alias("ib_low"), F.max("level").alias("high"), F.min("level").alias("low"),
        (F.max_by("n", "level") > 1).alias("poor_high"), (F.min_by("n", "level") > 1).alias("poor_low"),
    )
    area = value_area(t, ["exchange", "day"], volume="n").select("exchange", "day", "vah", "val")
    return g.withColumns({"up": F.col("high") > F.col("ib_high"), "down": F.col("low") < F.col("ib_low")}).join(area, ["exchange", "day"])


def value_migration(areas: DataFrame) -> DataFrame:
    """Each day's value area against the day before: kind, overlap and shift of the poc."""
    w = Window.partitionBy("exchange").orderBy("day")
    a = areas.withColumns({"_h": F.lag("vah").over(w), "_l": F.lag("val").over(w), "_p": F.lag("poc").over(w)}).filter("_h is not null")
    h, l = F.col("vah"), F.col("val")  # noqa: E741
    kind = (
        F.when((h == F.col("_h")) & (l == F.col("_l")), "unchanged").when(l > F.col("_h"), "higher").when(h < F.col("_l"), "lower").when((h <= F.col("_h")) & (l >= F.col("_l")), "inside")
        .when((h >= F.col("_h")) & (l <= F.col("_l")), "outside").when(h > F.col("_h"), "overlapping_higher").otherwise("overlapping_lower")
    )
    overlap = F.greatest(F.least(h, F.col("_h")) - F.greatest(l, F.col("_l")), F.lit(0.0))
    return a.select("exchange", "day", kind.alias("kind"), overlap.alias("overlap"), (F.col("poc") - F.col("_p")).alias("poc_shift"))


def footprint(trades: DataFrame, bar_ms: int, tick: float, times: float = 3.0) -> DataFrame:
    """exchange, bar, level (floored): buy, sell, and diagonal imbalances against the neighbouring tick."""
    level = F.floor(F.round(F.col("price") / tick, 9)).cast("long")
    g = trades.groupBy("exchange", bar_of("ts_ms", bar_ms).alias("bar"), level.alias("level")).agg(
        F.sum(F.when(F.col("aggressor_buy"), F.col("qty")).otherwise(0.0)).alias("buy"), F.sum(F.when(~F.col("aggressor_buy"), F.col("qty")).otherwise(0.0)).alias("sell")
    )
    w = Window.partitionBy("exchange", "bar").orderBy("level")
    below = F.when(F.lag("level").over(w) == F.col("level") - 1, F.lag("sell").over(w)).otherwise(0.0)
    above = F.when(F.lead("level").over(w) == F.col("level") + 1, F.lead("buy").over(w)).otherwise(0.0)
    return g.withColumns({"buy_imbalance": (F.col("buy") > 0) & (F.col("buy") >= times * below), "sell_imbalance": (F.col("sell") > 0) & (F.col("sell") >= times * above)})


def footprint_bars(trades: DataFrame, bar_ms: int) -> DataFrame:
    """Delta of each bar with the lowest and highest point of its path."""
    sign = F.when(F.col("aggressor_buy"), F.col("qty")).otherwise(-F.col("qty"))
    t = trades.withColumn("bar", bar_of("ts_ms", bar_ms))
    w = Window.partitionBy("exchange", "bar").orderBy("ts_ms", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("_d", F.sum(sign).over(w)).groupBy("exchange", "bar").agg(F.max_by("_d", F.struct("ts_ms", "trade_id")).alias("delta"), F.least(F.min("_d"), F.lit(0.0)).alias("delta_min"), F.greatest(F.max("_d"), F.lit(0.0)).alias("delta_max"))


def stacked_imbalances(prints: DataFrame, least: int = 3) -> DataFrame:
    """Runs of at least `least` neighbouring levels with an imbalance on one side, and whether a later bar traded through them."""
    sides = prints.select("exchange", "bar", "level", F.explode(F.array(F.struct(F.lit("buy").alias("side"), F.col("buy_imbalance").alias("on")), F.struct(F.lit("sell").alias("side"), F.col("sell_imbalance").alias("on")))).alias("s")).select("exchange", "bar", "level", "s.side", "s.on").filter("on")
    w = Window.partitionBy("exchange", "bar", "side").orderBy("level")
    runs = sides.withColumn("_g", F.col("level") - F.row_number().over(w)).groupBy("exchange", "bar", "side", "_g").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_g")
    span = prints.groupBy("exchange", "bar").agg(F.min("level").alias("lo"), F.max("level").alias("hi"))
    ahead = Window.partitionBy("exchange").orderBy("bar").rowsBetween(1, Window.unboundedFollowing)
    span = span.select("exchange", "bar", F.min("lo").over(ahead).alias("next_lo"), F.max("hi").over(ahead).alias("next_hi"))
    through = F.when(F.col("side") == "buy", F.col("next_lo") < F.col("low")).otherwise(F.col("next_hi") > F.col("high"))
    return runs.join(span, ["exchange", "bar"]).select("exchange", "bar", "side", "low", "high", "n", F.coalesce(through, F.lit(False)).alias("invalid"))


def delta_profile(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Delta of each level and its size against the nearest-rank 95th percentile, at most 1."""
    d = levels.withColumn("delta", F.col("buy") - F.col("sell"))
    ranked = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.abs("delta"))).alias("l"))
    p95 = ranked.select(*keys, F.element_at("l", F.greatest(F.ceil(0.95 * F.size("l")), F.lit(1)).cast("int")).alias("p95"))
    return d.join(p95, keys).withColumn("intensity", F.least(F.coalesce(F.try_divide(F.abs("delta"), F.col("p95")), F.lit(0.0)), F.lit(1.0)))


def liquidation_bands(trades: DataFrame, tick: float, leverages: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """Where positions opened at each level would be liquidated, by leverage, as a share of the largest band."""
    lv = trades.groupBy("exchange", snap(F.col("price"), tick).alias("level")).agg(F.sum(F.when(F.col("aggressor_buy"), F.col("qty")).otherwise(0.0)).alias("long"), F.sum(F.when(~F.col("aggressor_buy"), F.col("qty")).otherwise(0.0)).alias("short"))
    b = lv.withColumn("x", F.explode(F.array(*map(F.lit, leverages))))
    one = lambda side, p, q: F.struct(F.lit(side).alias("side"), F.floor(F.round(p / tick, 9)).cast("long").alias("at"), q.alias("q"))
    b = b.select("exchange", F.explode(F.array(one("long", F.col("level") * (1 - 1 / F.col("x")), F.col("long")), one("short", F.col("level") * (1 + 1 / F.col("x")), F.col("short")))).alias("s")).select("exchange", "s.*")
    g = b.groupBy("exchange", "side", "at").agg(F.sum("q").alias("q")).filter("q > 0")
    return g.withColumn("share", F.col("q") / F.max("q").over(Window.partitionBy("exchange")))
