"""Event-time bars: trades, liquidations and books by bar, coverage and segments, the volume clock, and their assembly.

Bars are half open and left labelled: bar = floor(ts_ms / bar_ms). Unknown is NULL: a bar without
trades has NULL prices, and zero flow only while the tape is known to be alive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import size_tier
from tidemark.operators.asof import asof_join
from tidemark.sources.schemas import DAY_MS

TIERS = ("small", "medium", "large", "whale")


def bar_of(ts: str | Column, bar_ms: int) -> Column:
    return F.floor((F.col(ts) if isinstance(ts, str) else ts) / bar_ms).cast("long")


def trade_bars(trades: DataFrame, bar_ms: int, keys: tuple[str, ...] = ("exchange",)) -> DataFrame:
    """OHLC by (ts_ms, trade_id), volume, signed volume, notional, and signed notional by size; one shuffle."""
    at = F.struct("ts_ms", "trade_id")
    p, q = F.col("price"), F.col("qty")
    sign = F.when(F.col("aggressor_buy"), 1.0).when(~F.col("aggressor_buy"), -1.0)
    tier = size_tier(p * q)
    return trades.groupBy(*keys, bar_of("ts_ms", bar_ms).alias("bar")).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.sum(q).alias("volume"), F.count("*").alias("n"),
        F.sum(F.when(sign > 0, q).otherwise(0.0)).alias("buy"), F.sum(F.when(sign < 0, q).otherwise(0.0)).alias("sell"), F.sum(p * q).alias("notional"),
        *[F.sum(F.when(tier == k, F.coalesce(sign, F.lit(0.0)) * p * q).otherwise(0.0)).alias(f"delta_{t}") for k, t in enumerate(TIERS)],
    )


def liquidation_bars(liq: DataFrame, bar_ms: int, keys: tuple[str, ...] = ("exchange",)) -> DataFrame:
    side = F.lower("side")
    v = F.col("notional_usd")
    return liq.groupBy(*keys, bar_of("ts_ms", bar_ms).alias("bar")).agg(
        F.count("*").alias("liq_n"), F.sum(v).alias("liq_notional"), F.sum(F.when(side == "long", v).otherwise(0.0)).alias("liq_long"), F.sum(F.when(side == "short", v).otherwise(0.0)).alias("liq_short"),
    )


def grid(spark: SparkSession, start_ms: int, end_ms: int, bar_ms: int) -> DataFrame:
    """Every bar of [start, end), by a range and not by a list."""
    return spark.range(start_ms // bar_ms, -(-end_ms // bar_ms)).withColumnRenamed("id", "bar")


def holes(events: DataFrame, start_ms: int, end_ms: int, gap_ms: int, keys: tuple[str, ...] = ("exchange",)) -> DataFrame:
    """h0, h1: silences longer than gap_ms, the window's head and tail included.

    Two events more than gap_ms apart lie in different cells of that width, so the first and last event of each
    cell are enough: events are reduced by a partial aggregation and never sorted or shuffled as rows.
    """
    seen = events.filter((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    cells = seen.groupBy(*keys, bar_of("ts_ms", max(gap_ms, 1)).alias("_cell")).agg(F.min("ts_ms").alias("_a"), F.max("ts_ms").alias("_z"))
    w = Window.partitionBy(*keys).orderBy("_cell")
    before = F.struct(F.coalesce(F.lag("_z").over(w), F.lit(start_ms)).alias("h0"), F.col("_a").alias("h1"))
    tail = F.when(F.lead("_a").over(w).isNull(), F.struct(F.col("_z").alias("h0"), F.lit(end_ms).cast("long").alias("h1")))
    sides = cells.select(*keys, before.alias("_before"), tail.alias("_tail"))
    return sides.select(*keys, F.explode(F.array_compact(F.array("_before", "_tail"))).alias("_h")).select(*keys, "_h.h0", "_h.h1").filter(F.col("h1") - F.col("h0") > gap_ms)


def gap_by_bar(gaps: DataFrame, bar_ms: int, keys: tuple[str, ...] = ("exchange",)) -> DataFrame:
    """gap_ms of each bar that a hole touches: holes are exploded into the bars they overlap, so no range join is needed."""
    first, last = F.floor(F.col("h0") / bar_ms), F.floor((F.col("h1") - 1) / bar_ms)
    parts = gaps.withColumn("bar", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    overlap = F.least("h1", (F.col("bar") + 1) * bar_ms) - F.greatest("h0", F.col("bar") * bar_ms)
    return parts.groupBy(*keys, "bar").agg(F.least(F.sum(overlap), F.lit(bar_ms)).alias("gap_ms"))


def covered_bars(trades: DataFrame, start_ms: int, end_ms: int, bar_ms: int, gap_ms: int) -> DataFrame:
    """Every (exchange, bar) of the window with trade columns, coverage, segment, cvd, vwap and gap flags.

    A segment is a run of wholly covered bars; any other bar has a segment of its own, and the cvd begins anew in each.
    """
    venues = trades.select("exchange").distinct()
    every = venues.crossJoin(F.broadcast(grid(trades.sparkSession, start_ms, end_ms, bar_ms)))  # the grid's size is fixed by the window
    inside = trades.filter((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    out = every.join(trade_bars(inside, bar_ms), ["exchange", "bar"], "left").join(gap_by_bar(holes(inside, start_ms, end_ms, gap_ms), bar_ms), ["exchange", "bar"], "left")
    coverage = 1 - F.coalesce("gap_ms", F.lit(0)) / bar_ms
    out = out.withColumn("coverage", coverage)
    alive = F.col("coverage") > 0
    flow = ["volume", "buy", "sell", "notional", "n", *[f"delta_{t}" for t in TIERS]]
    out = out.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c)).when(alive, F.lit(0)) for c in flow})
    w = Window.partitionBy("exchange").orderBy("bar")
    whole = F.col("coverage") >= 1
    fresh = F.when(whole & F.coalesce(F.lag(whole).over(w), F.lit(False)), 0).otherwise(1)
    out = out.withColumn("_fresh", fresh).withColumn("segment", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_fresh")
    out = out.withColumns({"delta": F.col("buy") - F.col("sell"), "vwap": F.try_divide("notional", "volume"), "is_gap": F.col("coverage") < 1})
    cvd = F.sum(F.coalesce("delta", F.lit(0.0))).over(Window.partitionBy("exchange", "segment").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0))
    spans = (F.col("coverage") < 1) | F.coalesce(F.lag("coverage").over(w) < 1, F.lit(True)) | F.col("close").isNull() | F.lag("close").over(w).isNull()
    return out.withColumns({"cvd": F.when(F.col("delta").isNotNull(), cvd), "ret_spans_gap": spans})


def coverage_mask(least: float = 1.0) -> Column:
    return (F.col("coverage") >= least) & ~F.col("ret_spans_gap")


def drop_gap_bars(bars: DataFrame, least: float = 1.0) -> DataFrame:
    return bars.filter(coverage_mask(least))


def gap_flat_positions(bars: DataFrame, position: str = "position", keys: tuple[str, ...] = ("exchange",)) -> DataFrame:
    """Position 0 where the next bar's return spans a gap; the last bar is flat."""
    w = Window.partitionBy(*keys).orderBy("bar")
    return bars.withColumn(position, F.when(F.coalesce(F.lead("ret_spans_gap").over(w), F.lit(True)), 0.0).otherwise(F.col(position)))


def coverage_summary(bars: DataFrame) -> DataFrame:
    c = F.col("coverage")
    return bars.groupBy("exchange").agg(
        F.count("*").alias("bars"), F.count(F.when(c >= 1, 1)).alias("full"), F.count(F.when((c > 0) & (c < 1), 1)).alias("partial"), F.count(F.when(c <= 0, 1)).alias("empty"),
        F.coalesce(F.sum("gap_ms"), F.lit(0)).alias("gap_ms"), F.countDistinct(F.when(c >= 1, F.col("segment"))).alias("segments"),
    )


# -- volume clock


def daily_volume(trades: DataFrame) -> DataFrame:
    return trades.groupBy("exchange", bar_of("ts_ms", DAY_MS).alias("day")).agg(F.sum("qty").alias("volume"))


def causal_bucket_volume(daily: DataFrame, buckets_per_day: int) -> DataFrame:
    """day, bucket_volume: the median positive volume of strictly earlier days, over buckets_per_day; NULL on the first."""
    w = Window.partitionBy("exchange").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    past = F.array_sort(F.collect_list(F.when(F.col("volume") > 0, F.col("volume"))).over(w))
    n = F.size("_past")
    median = F.when(n > 0, (F.get("_past", F.floor((n - 1) / 2).cast("int")) + F.get("_past", F.floor(n / 2).cast("int"))) / 2)
    return daily.withColumn("_past", past).select("exchange", "day", (median / buckets_per_day).alias("bucket_volume"))


def volume_buckets(trades: DataFrame, buckets_per_day: int = 50, window: int = 50, bucket_volume: float | None = None, gap_ms: int = 60_000) -> DataFrame:
    """Day-anchored buckets of equal volume; a trade is split exactly where a bucket ends; only complete buckets.

    exchange, day, k, open_ms, close_ms, buy, sell, trade_count, duration_s, imbalance and vpin (mean imbalance of the
    last window buckets) with window_span_s, the time that those buckets took, and window_gap_s, the silences longer than
    gap_ms inside it: those within its buckets and between them, each counted in full.
    """
    t = trades.filter(F.col("qty") > 0).withColumn("day", bar_of("ts_ms", DAY_MS))
    if bucket_volume is None:
        t = t.join(causal_bucket_volume(daily_volume(trades), buckets_per_day), ["exchange", "day"]).filter(F.col("bucket_volume") > 0)
    else:
        t = t.withColumn("bucket_volume", F.lit(float(bucket_volume)))
    order = Window.partitionBy("exchange", "day").orderBy("ts_ms", "trade_id")
    t = t.withColumns({"c1": F.sum("qty").over(order.rowsBetween(Window.unboundedPreceding, 0)), "step": F.col("ts_ms") - F.lag("ts_ms").over(order)}).withColumn("c0", F.col("c1") - F.col("qty"))
    v = F.col("bucket_volume")
    first, last = F.floor(F.col("c0") / v).cast("long"), (F.ceil(F.col("c1") / v) - 1).cast("long")
    t = t.withColumn("k", F.explode(F.sequence(first, F.greatest(first, last))))
    t = t.withColumn("part", F.least("c1", (F.col("k") + 1) * v) - F.greatest("c0", F.col("k") * v)).filter("part > 0")
    g = t.groupBy("exchange", "day", "k").agg(
        F.max("bucket_volume").alias("bucket_volume"), F.min("ts_ms").alias("open_ms"), F.max("ts_ms").alias("close_ms"), F.sum("part").alias("volume"),
        F.sum(F.when(F.col("aggressor_buy"), F.col("part")).otherwise(0.0)).alias("buy"), F.sum(F.when(~F.col("aggressor_buy"), F.col("part")).otherwise(0.0)).alias("sell"), F.count("*").alias("trade_count"),
        F.coalesce(F.sum(F.when((F.col("c0") > F.col("k") * v) & (F.col("step") > gap_ms), F.col("step"))), F.lit(0)).alias("_inner"),  # the print before is in the bucket too
    )
    g = g.filter(F.col("volume") >= F.col("bucket_volume") * (1 - 1e-9)).withColumn("imbalance", F.abs(F.col("buy") - F.col("sell")) / F.col("bucket_volume"))
    own = Window.partitionBy("exchange").orderBy("day", "k")
    roll = own.rowsBetween(-(window - 1), 0)
    full = F.count("*").over(roll) == window
    silence = F.col("open_ms") - F.lag("close_ms").over(own)
    g = g.withColumn("_between", F.when(silence > gap_ms, silence).otherwise(0))
    return g.withColumns({
        "duration_s": (F.col("close_ms") - F.col("open_ms")) / 1000, "vpin": F.when(full, F.avg("imbalance").over(roll)),
        "window_span_s": F.when(full, (F.col("close_ms") - F.lag("open_ms", window - 1).over(own)) / 1000),
        "window_gap_s": F.when(full, (F.sum("_inner").over(roll) + F.sum("_between").over(roll) - F.lag("_between", window - 1).over(own)) / 1000),
    }).drop("_inner", "_between")


def vpin_on_grid(buckets: DataFrame, bars: DataFrame, bar_ms: int) -> DataFrame:
    """bars with vpin and its age from the last bucket that closed strictly before the bar's end."""
    left = bars.withColumn("_end", (F.col("bar") + 1) * bar_ms)
    right = buckets.filter("vpin is not null").groupBy("exchange", "close_ms").agg(F.max_by("vpin", F.struct("day", "k")).alias("vpin"))
    out = asof_join(left, right.withColumnRenamed("close_ms", "_close"), ["exchange"], "_end", "_close", strict=True)
    return out.withColumn("vpin_age_ms", F.col("_end") - F.col("_close")).drop("_end", "_close")


def order_flow_bars(trades: DataFrame, start_ms: int, end_ms: int, bar_ms: int, gap_ms: int, buckets_per_day: int = 20, window: int = 10) -> DataFrame:
    """Covered bars with the volume clock's vpin."""
    return vpin_on_grid(volume_buckets(trades, buckets_per_day, window), covered_bars(trades, start_ms, end_ms, bar_ms, gap_ms), bar_ms)
