"""Cleaning, alignment, provenance and reports of series and frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import expected_max_sharpe, min_backtest_length
from tidemark.functions.windows import by, finite, ratio, running_sums
from tidemark.operators.quality import first_of

OHLCV = ("open", "high", "low", "close", "volume")


def normalize_ohlcv(df: DataFrame, order: str, series: str = "series", ts: str = "ts") -> DataFrame:
    """Numbers by force (else NULL), the last row (by `order`, the arrival) of each time."""
    d = df.select(series, ts, order, *[F.col(c).cast("string").try_cast("double").alias(c) for c in OHLCV])
    return first_of(d, [series, ts], [F.desc(order)]).drop(order)


def slice_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows of [start, end], both ends inside; None is open."""
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    return df if end is None else df.filter(F.col(ts) <= end)


def align(positions: DataFrame, prices: DataFrame, order: str, keys: tuple[str, ...] = ("series", "day")) -> DataFrame:
    """Inner join by time after keeping the first row (by order) of each time on both sides."""
    return first_of(positions, list(keys), [order]).drop(order).join(first_of(prices, list(keys), [order]).drop(order), list(keys))


def buy_and_hold_equity(prices: DataFrame, series: str = "series", ts: str = "day") -> DataFrame:
    return prices.withColumn("equity", ratio(F.col("close"), F.first("close").over(by(series, ts))))


def last_finite(x: str, ts: str = "ts") -> Column:
    return F.max_by(x, F.when(finite(F.col(x)).isNotNull(), F.col(ts)))


def periods_per_year(df: DataFrame, series: str = "series", ts: str = "ts_ms") -> DataFrame:
    """Settlements a year, from the median spacing."""
    s = df.select(series, (F.col(ts) - F.lag(ts).over(by(series, ts))).alias("d")).filter("d > 0")
    return s.groupBy(series).agg((365 * 86_400_000 / F.percentile("d", F.lit(0.5))).alias("per_year"))


def report(bt: DataFrame, keys: tuple[str, ...] = ("series",), ts: str = "day", n: int = 90) -> DataFrame:
    """One JSON text for each key: equity, drawdown, rolling Sharpe, turnover and the price held, by time. A report is as long as its series."""
    w = Window.partitionBy(*keys).orderBy(ts)
    frame = w.rowsBetween(-(n - 1), 0)
    d = bt.withColumns({
        "drawdown": ratio(F.col("equity"), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1,
        "rolling_sharpe": F.when(F.count("net").over(frame) == n, ratio(F.avg("net").over(frame), F.stddev_samp("net").over(frame)) * math.sqrt(365)), "hold": ratio(F.col("close"), F.first("close").over(w)),
    })
    point = F.struct(F.col(ts).cast("string").alias("t"), *[F.round(c, 8).alias(c) for c in ("net", "equity", "drawdown", "rolling_sharpe", "turnover", "hold")])
    return d.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(point))).alias("report"))


# -- provenance of bars

#: Where a bar's rows came from; fixed codes.
SOURCES = {1: "local", 2: "hub", 3: "archive"}


def source_label(code: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in SOURCES.items():
        out = out.when(code == k, v)
    return out


def archive_mask() -> Column:
    return F.col("source_code") == 3


def drop_archive_bars(bars: DataFrame) -> DataFrame:
    return bars.filter(~F.coalesce(archive_mask(), F.lit(False)))


def segments(bars: DataFrame, least: float = 1.0) -> DataFrame:
    """Covered runs of bars: first and last bar and their number."""
    from tidemark.functions.windows import islands

    d = bars.withColumn("segment", islands(F.col("coverage") >= least, by("exchange", "bar"))).filter("segment is not null")
    return d.groupBy("exchange", "segment").agg(F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"), F.count("*").alias("bars"))


def history_summary(manifest: DataFrame, trials: tuple[int, ...] = (5, 20, 100)) -> DataFrame:
    """Years between first and last row, and that as a share of the backtest length that each number of trials needs."""
    g = manifest.agg(((F.max("ts_max") - F.min("ts_min")) / (365 * 86_400_000)).alias("years"))
    return g.withColumns({f"of_{n}": F.col("years") / min_backtest_length(n) for n in trials})


#: Column, formula and unit of the bar frame.
COLUMNS = (
    ("open", "price of the first print by (ts_ms, trade_id)", "price"), ("high", "highest price", "price"), ("low", "lowest price", "price"), ("close", "price of the last print by (ts_ms, trade_id)", "price"),
    ("volume", "sum of qty", "coin"), ("delta", "buy minus sell", "coin"), ("vwap", "notional over volume", "price"), ("cvd", "sum of delta since the segment began", "coin"),
    ("coverage", "1 minus silence longer than the gap over the bar", "share"), ("segment", "number of the run of wholly covered bars", "index"), ("vpin", "mean imbalance of the last buckets closed before the bar's end", "share"),
)


def provenance(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COLUMNS, "column string, formula string, unit string")


def dsr_variances(stats: DataFrame, n_trials: int) -> DataFrame:
    """The bar a Sharpe ratio a period must beat under three readings of the trials' variance: that of the trials (a), the estimate's own (b1), and their mean (b2)."""
    sr = F.col("sharpe") / math.sqrt(365)
    s = stats.withColumn("sr", sr).withColumn("own", (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2) / (F.col("n") - 1))
    v = s.agg(F.var_samp("sr").alias("_a"), F.avg("own").alias("_b"))
    k = expected_max_sharpe(n_trials)
    return s.crossJoin(F.broadcast(v)).select("strategy", "sr", (F.sqrt("_a") * k).alias("bar_a"), (F.sqrt("own") * k).alias("bar_b1"), (F.sqrt("_b") * k).alias("bar_b2"))  # one row


def pooled(day_stats: DataFrame, replicates: int = 200, seed: int = 0) -> DataFrame:
    """horizon, median of the days' medians, mean of their means and its bootstrap interval; days are resampled by Poisson weights, side by side."""
    reps = day_stats.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.pmod(F.xxhash64("day", "rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((F.when(u > c, 1).otherwise(0) for c in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)]).tolist()), F.lit(0))
    boot = reps.withColumn("_w", weight).groupBy("horizon", "rep").agg(ratio(F.sum(F.col("_w") * F.col("mean")), F.sum("_w")).alias("m"))
    ci = boot.groupBy("horizon").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return day_stats.groupBy("horizon").agg(F.percentile("median", F.lit(0.5)).alias("median"), F.avg("mean").alias("mean")).join(ci, "horizon")


# -- recorded depth frames


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of gzip files, whole members read even where the last one is torn; column seq keeps the order inside a file.

    A gzip file cannot be split, so a file is one task's work; recorders rotate them by the hour or day.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import zlib

        for b in batches:
            for name, raw in zip(b["path"], b["content"]):
                text, at = [], 0
                while at < len(raw):
                    d = zlib.decompressobj(31)
                    try:
                        text.append(d.decompress(raw[at:]))
                    except zlib.error:
                        break
                    if not d.eof:
                        break
                    at = len(raw) - len(d.unused_data)
                lines = b"".join(text).decode("utf-8", "replace").split("\n")
                if raw and not (lines and lines[-1] == ""):
                    lines = lines[:-1]  # a torn line
                keep = [(i, x) for i, x in enumerate(lines) if x.strip()]
                yield pd.DataFrame({"path": name, "seq": [i for i, _ in keep], "frame": [x for _, x in keep]})

    return files.mapInPandas(run, "path string, seq long, frame string")


def frame_census(frames: DataFrame) -> DataFrame:
    """By hour: frames, gaps, snapshots and nearest-rank latencies. frames: kind, recv_ms, event_ms."""
    hour = F.floor(F.col("recv_ms") / 3_600_000).cast("long")
    late = F.sort_array(F.collect_list(F.when(F.col("kind") == "frame", F.col("recv_ms") - F.col("event_ms"))))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}s")
    g = frames.groupBy(hour.alias("hour")).agg(count("frame"), count("gap"), count("snapshot"), late.alias("_l"))
    rank = lambda q: F.get("_l", F.greatest(F.ceil(q * F.size("_l")) - 1, F.lit(0)).cast("int"))
    return g.select("hour", "frames", "gaps", "snapshots", rank(0.5).alias("p50"), rank(0.99).alias("p99"))


def rebuilt_agreement(events: DataFrame, depths: tuple[int, ...] = (1, 5)) -> DataFrame:
    """How often a book rebuilt from updates equals the next snapshot in its best levels.

    events: symbol, seq, kind (snapshot or update), bids, asks (arrays of [price, qty]); one symbol is replayed in order in one task.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        book, hits, n = None, {d: 0 for d in depths}, 0
        best = lambda side, rev, d: sorted(((p, q) for p, q in side.items() if q), reverse=rev)[:d]
        for row in g.sort_values("seq").itertuples():
            sides = [{float(p): float(q) for p, q in x} for x in (row.bids, row.asks)]
            if row.kind == "snapshot":
                if book is not None:
                    n += 1
                    for d in depths:
                        hits[d] += all(best(a, rev, d) == best(b, rev, d) for a, b, rev in zip(book, sides, (True, False)))
                book = sides
            elif book is not None:
                for side, change in zip(book, sides):
                    side.update(change)
        return pd.DataFrame({"symbol": g["symbol"].iloc[0], "depth": list(depths), "compared": n, "equal": [hits[d] for d in depths]})

    return events.groupBy("symbol").applyInPandas(run, "symbol string, depth long, compared long, equal long")


def multi_level_ofi(features: DataFrame, levels: int, window_ms: int, z_n: int) -> DataFrame:
    """Order-flow imbalance over the best levels of bids and asks, its sum over a trailing window and that sum's z-score."""
    w = by("exchange", "ts_ms")
    total = F.lit(0.0)
    at = lambda side, i, k: F.get(F.get(side, F.lit(i)), F.lit(k))
    d = features.withColumns({"_b": F.lag("bids").over(w), "_a": F.lag("asks").over(w)})
    for i in range(levels):
        bp, bq, ap, aq = at("bids", i, 0), at("bids", i, 1), at("asks", i, 0), at("asks", i, 1)
        bp0, bq0, ap0, aq0 = at("_b", i, 0), at("_b", i, 1), at("_a", i, 0), at("_a", i, 1)
        total = total + F.when(bp >= bp0, bq).otherwise(0.0) - F.when(bp <= bp0, bq0).otherwise(0.0) - F.when(ap <= ap0, aq).otherwise(0.0) + F.when(ap >= ap0, aq0).otherwise(0.0)
    d = d.withColumn("ofi", F.when(F.col("_b").isNotNull(), total)).drop("_b", "_a")
    d = d.withColumn("ofi_sum", F.sum("ofi").over(w.rangeBetween(-(window_ms - 1), 0)))
    frame = w.rowsBetween(-(z_n - 1), 0)
    return d.withColumn("ofi_z", F.when(F.count("ofi_sum").over(frame) == z_n, ratio(F.col("ofi_sum") - F.avg("ofi_sum").over(frame), F.stddev_samp("ofi_sum").over(frame))))


def pulled_walls(levels: DataFrame, trades: DataFrame, times: float = 8.0, within_ms: int = 15_000, cover: float = 0.2) -> DataFrame:
    """Large levels that vanished soon after they came with little traded at their price (spoof), or traded far more than they ever showed (iceberg).

    levels: exchange, ts_ms, side, price, qty. A level is large from `times` its snapshot's median on. Runs of snapshots are found by gaps and
    islands; what was traded at a price while a run stood is a difference of running sums, so prints are not joined with runs.
    """
    med = levels.groupBy("exchange", "ts_ms").agg(F.percentile("qty", F.lit(0.5)).alias("_m"))
    snaps = levels.select("exchange", "ts_ms").distinct().withColumn("no", F.row_number().over(by("exchange", "ts_ms"))).withColumn("next_ms", F.lead("ts_ms").over(by("exchange", "ts_ms")))
    d = levels.join(med, ["exchange", "ts_ms"]).filter(F.col("qty") >= times * F.col("_m")).join(snaps, ["exchange", "ts_ms"])
    d = d.withColumn("_g", F.col("no") - F.row_number().over(Window.partitionBy("exchange", "side", "price").orderBy("no")))
    runs = d.groupBy("exchange", "side", "price", "_g").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.max_by("next_ms", "ts_ms").alias("gone_ms"), F.max("qty").alias("shown")).drop("_g")
    t = trades.select("exchange", "price", F.col("ts_ms").alias("_t"), F.col("qty").alias("_q"))
    # the sum at a price between two times is the difference of two running sums: each run puts in one mark before its first time and one after its last
    run = F.struct("side", "first_ms", "last_ms", "gone_ms", "shown")
    mark = lambda at, side: runs.select("exchange", "price", at.alias("ts_ms"), F.lit(side).alias("_side"), F.lit(0.0).alias("_q"), run.alias("_run"))
    t = t.join(runs.select("exchange", "price").distinct(), ["exchange", "price"], "left_semi").select("exchange", "price", F.col("_t").alias("ts_ms"), F.lit(0).alias("_side"), "_q", F.lit(None).cast(runs.select(run.alias("r")).schema["r"].dataType).alias("_run"))
    sums = running_sums(t.unionByName(mark(F.col("first_ms"), -1)).unionByName(mark(F.coalesce("gone_ms", "last_ms"), 1)), {"_sum": F.col("_q")}, ["exchange", "price"], ties=("_side",))
    g = sums.filter(F.col("_side") != 0).groupBy("exchange", "price", "_run").agg(F.round(F.sum(F.col("_side") * F.col("_sum")), 9).alias("traded")).select("exchange", "price", "_run.*", "traded")
    kind = F.when(F.col("traded") >= 3 * F.col("shown"), "iceberg").when(F.col("gone_ms").isNotNull() & (F.col("gone_ms") - F.col("first_ms") <= within_ms) & (F.col("traded") < cover * F.col("shown")), "spoof").otherwise("wall")
    return g.withColumn("kind", kind)


# -- the journal as CSV

JOURNAL = "ts_ms bigint, symbol string, side string, r double, tag string, note string"


def journal_from_csv(lines: DataFrame) -> DataFrame:
    """Rows with an array of errors: not the right number of fields, no time, no side, R not a number."""
    d = lines.withColumn("f", F.from_csv("line", "ts_ms string, symbol string, side string, r string, tag string, note string", {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}))
    bad = lambda c, text: F.when(c, F.lit(text))
    errors = F.array_compact(F.array(
        bad(F.col("f.ts_ms").try_cast("bigint").isNull(), "time"), bad(F.coalesce("f.symbol", F.lit("")) == "", "symbol"), bad(~F.coalesce(F.lower("f.side"), F.lit("")).isin("long", "short"), "side"),
        bad((F.coalesce("f.r", F.lit("")) != "") & F.col("f.r").try_cast("double").isNull(), "r"),
    ))
    return d.select(F.col("f.ts_ms").try_cast("bigint").alias("ts_ms"), "f.symbol", F.lower("f.side").alias("side"), F.col("f.r").try_cast("double").alias("r"), "f.tag", "f.note", errors.alias("errors"))


def journal_to_csv(journal: DataFrame) -> DataFrame:
    return journal.select(F.to_csv(F.struct("ts_ms", "symbol", "side", "r", "tag", "note"), {"quote": '"', "escape": '"'}).alias("line"))


def venue_ids(symbol: Column) -> Column:
    """A base like BTC as each venue spells its perpetual or pair."""
    s = F.upper(F.trim(symbol))
    return F.struct(F.concat(s, F.lit("USDT")).alias("binance"), F.concat(s, F.lit("USDT")).alias("bybit"), F.concat(s, F.lit("-USDT-SWAP")).alias("okx"), F.concat(s, F.lit("-USD")).alias("coinbase"), F.concat(s, F.lit("-PERPETUAL")).alias("deribit"))
