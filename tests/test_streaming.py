"""Streams over files give what the batch gives."""

import json

from pyspark.sql import functions as F

from tidemark.sources.schemas import TABLES
from tidemark.streaming import live

DAY = 1_704_067_200_000


def stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def prints(n, first=0, step=60_000):
    return [("v", "X", str(first + i), DAY + (first + i) * step, 100.0 + (first + i) % 5, 1.0, True) for i in range(n)]


def test_bars_and_dedup(spark, tmp_path):
    rows = prints(200)
    s = stream(spark, tmp_path, [rows, rows[-5:], prints(2, 400)], TABLES["trades"])
    got = live.replay(live.stream_bars(live.deduplicated(live.with_time(s)), "1 hour"), "bars")
    want = {tuple(r) for r in live.batch_bars(spark.createDataFrame(rows, TABLES["trades"]), 3_600_000).select(*got.columns).collect()}
    assert {tuple(r) for r in got.collect() if r["start_ms"] < DAY + 3 * 3_600_000} == {w for w in want if w[1] < DAY + 3 * 3_600_000}


def test_ids_and_downsample(spark, tmp_path):
    s = stream(spark, tmp_path, [prints(20), prints(25)], TABLES["trades"])
    assert live.replay(live.new_ids_only(s), "ids").count() == 25
    got = [r["ts_ms"] for r in live.replay(live.stream_downsample(s, 300_000), "down").orderBy("ts_ms").collect()]
    assert all(b - a >= 300_000 for a, b in zip(got, got[1:])) and got


def test_book(spark, tmp_path):
    schema = "symbol string, ts_ms long, kind string, bids string, asks string"
    rows = [("X", 0, "delta", "[[1,1]]", "[]"), ("X", 1, "snapshot", "[[10,1],[9,2]]", "[[11,1]]"), ("X", 2, "delta", "[[10,0],[9.5,4]]", "[[12,3]]")]
    got = live.replay(live.stream_book(stream(spark, tmp_path, [rows], schema)), "book").orderBy("ts_ms").collect()
    assert [r["ts_ms"] for r in got] == [1, 2]
    assert json.loads(got[-1]["bids"]) == [[9.5, 4.0], [9.0, 2.0]] and json.loads(got[-1]["asks"]) == [[11.0, 1.0], [12.0, 3.0]]


def test_day_sink_and_future_rows(spark, tmp_path):
    rows = prints(30, step=3_600_000)
    s = live.with_time(stream(spark, tmp_path, [rows], TABLES["trades"]), ahead_ms=0, now_ms=DAY + 20 * 3_600_000)
    q = live.day_sink(s, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 21 and out.select("date").distinct().count() == 1


def test_sessions(spark, tmp_path):
    rows = prints(3) + prints(3, 100) + prints(1, 1000)
    got = live.replay(live.stream_sessions(live.with_time(stream(spark, tmp_path, [rows, prints(1, 3000)], TABLES["trades"])), "10 minutes"), "sessions")
    assert {r["n"] for r in got.filter(F.col("first_ms") < DAY + 900 * 60_000).collect()} == {3}
