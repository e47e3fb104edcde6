"""Streaming: wire frames in, clean day-partitioned ticks and closed bars out.

Event time is ts_ms. A row's day stays open for a grace after it; Spark's watermark does that, and rows
from the future are held off first so that one bad clock cannot close every day. State that has to
remember rows (last id, last kept row, book) is keyed and bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.bars import trade_bars
from tidemark.sources.schemas import DAY_MS

GRACE = "5 minutes"


def with_time(df: DataFrame, grace: str = GRACE, ahead_ms: int | None = None, now_ms=None) -> DataFrame:
    """Add ts and its watermark; with ahead_ms, rows later than now by more are dropped first."""
    if ahead_ms is not None:
        now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
        df = df.filter(F.col("ts_ms") <= now + ahead_ms)
    return df.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", grace)


def deduplicated(trades: DataFrame) -> DataFrame:
    """One row for each trade id among the rows the watermark still holds."""
    return trades.dropDuplicatesWithinWatermark(["exchange", "symbol", "trade_id"])


def stream_bars(trades: DataFrame, bar: str) -> DataFrame:
    """Closed bars in append mode: a late print never rewrites a bar that was given out."""
    at = F.struct("ts_ms", "trade_id")
    p, q = F.col("price"), F.col("qty")
    return trades.groupBy("exchange", F.window("ts", bar).alias("w")).agg(
        F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"), F.sum(q).alias("volume"), F.count("*").alias("n"),
    ).select("exchange", F.unix_millis("w.start").alias("start_ms"), "open", "high", "low", "close", "volume", "n")


def stream_sessions(rows: DataFrame, gap: str) -> DataFrame:
    """Bursts of rows no further apart than the gap."""
    return rows.groupBy("exchange", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("exchange", F.unix_millis("w.start").alias("first_ms"), "n")


def day_sink(df: DataFrame, path: str, checkpoint: str, interval: str = "500 milliseconds"):
    """Write by day of the row's own time, in micro-batches."""
    day = F.date_format(F.date_from_unix_date(F.floor(F.col("ts_ms") / DAY_MS).cast("int")), "yyyy-MM-dd")
    return df.withColumn("date", day).drop("ts").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("date").trigger(processingTime=interval)


def new_ids_only(trades: DataFrame) -> DataFrame:
    """Rows whose numeric id is above every id of their venue and symbol in earlier batches: a reconnect's first page repeats rows."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        top = last
        for f in frames:
            ids = f["trade_id"].astype("int64")
            fresh = f[ids > last].drop_duplicates("trade_id")
            top = max(top, int(ids.max())) if len(ids) else top
            if len(fresh):
                yield fresh
        state.update((top,))

    columns = trades.select("exchange", "symbol", "trade_id", "ts_ms", "price", "qty", "aggressor_buy")
    return columns.groupBy("exchange", "symbol").applyInPandasWithState(run, columns.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def stream_downsample(rows: DataFrame, ms: int) -> DataFrame:
    """At most one row for each venue and ms since the last row kept."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        f = pd.concat(list(frames)).sort_values("ts_ms")  # a venue's rows of one micro-batch come in several frames
        keep = []
        for i, t in enumerate(f["ts_ms"]):
            if last is None or t - last >= ms:
                keep.append(i)
                last = int(t)
        if keep:
            yield f.iloc[keep]
        if last is not None:
            state.update((last,))

    columns = rows.select("exchange", "ts_ms", "price")
    return columns.groupBy("exchange").applyInPandasWithState(run, columns.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def stream_book(updates: DataFrame, top: int = 50) -> DataFrame:
    """Books from snapshots and deltas (symbol, ts_ms, kind, bids, asks as JSON ladders): the best `top` levels after each update; size 0 deletes a level, and nothing is given out before the first snapshot."""
    import json

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = json.loads(state.get[0]) if state.exists else None
        for f in frames:
            out = []
            for row in f.sort_values("ts_ms").itertuples():
                if row.kind == "snapshot":
                    book = {"b": {}, "a": {}}
                if book is None:
                    continue
                for side, levels in (("b", row.bids), ("a", row.asks)):
                    for p, q in json.loads(levels):
                        book[side][repr(float(p))] = float(q)
                        if not float(q):
                            del book[side][repr(float(p))]
                best = {s: sorted(((float(p), q) for p, q in book[s].items()), reverse=s == "b")[:top] for s in "ba"}
                out.append((key[0], row.ts_ms, json.dumps([list(x) for x in best["b"]]), json.dumps([list(x) for x in best["a"]])))
            if out:
                yield pd.DataFrame(out, columns=["symbol", "ts_ms", "bids", "asks"])
        if book is not None:
            state.update((json.dumps(book),))

    columns = updates.select("symbol", "ts_ms", "kind", "bids", "asks")
    return columns.groupBy("symbol").applyInPandasWithState(run, "symbol string, ts_ms long, bids string, asks string", "book string", "append", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now and return what it gave out (tests, backfills)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def batch_bars(trades: DataFrame, bar_ms: int) -> DataFrame:
    """The same bars in batch, to hold a stream against."""
    return trade_bars(trades, bar_ms).select("exchange", (F.col("bar") * bar_ms).alias("start_ms"), "open", "high", "low", "close", "volume", "n")
