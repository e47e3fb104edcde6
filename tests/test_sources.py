"""The tick store: gates, day files, precedence, ledgers, caches."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.sources import ticks
from tidemark.sources.schemas import TABLES, tape

DAY = 1_704_067_200_000


def trades(spark, n=50, start=DAY, step=60_000, first=0):
    return spark.createDataFrame([("v", "X", str(first + i), start + i * step, 100.0 + i % 3, 0.5, i % 2 == 0) for i in range(n)], TABLES["trades"])


def test_write_and_read_a_day(spark, tmp_path):
    root = str(tmp_path)
    m = ticks.write_day(trades(spark), root, "trades", "2024-01-01")
    assert m["rows"] == 50
    got = ticks.read_ticks(spark, root, "trades", DAY + 600_000, DAY + 1_200_000)
    assert got.count() == 10 and got.columns[-1] == "source"
    assert "PushedFilters: [IsNotNull(ts_ms), GreaterThanOrEqual(ts_ms" in got._jdf.queryExecution().toString()
    assert ticks.read_ticks(spark, root, "trades", DAY - 10**9, DAY).count() == 0
    assert ticks.read_ticks(spark, root, "liquidations", DAY, DAY + 1).count() == 0


@pytest.mark.parametrize("spoil", [lambda d: d.filter("false"), lambda d: d.unionByName(d), lambda d: d.withColumn("ts_ms", F.col("ts_ms") + 86_400_000), lambda d: d.withColumn("ts_ms", F.floor(F.col("ts_ms") / 1000).cast("long"))])
def test_gates_refuse(spark, tmp_path, spoil):
    with pytest.raises(ticks.TickError):
        ticks.write_day(spoil(trades(spark)), str(tmp_path), "trades", "2024-01-01")


def test_precedence_and_catalog(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    ticks.write_day(trades(spark), a, "trades", "2024-01-01")
    ticks.write_day(trades(spark, 7), b, "trades", "2024-01-01")
    ticks.write_day(trades(spark, 9, DAY + 86_400_000), b, "trades", "2024-01-02")
    roots = {"local": a, "archive": b}
    got = ticks.read_ticks(spark, roots, "trades", DAY, DAY + 2 * 86_400_000)
    assert {(r["source"], r["count"]) for r in got.groupBy("source").count().collect()} == {("local", 50), ("archive", 9)}
    assert ticks.available_days(spark, roots, "trades").count() == 3
    assert ticks.normalize_source("auto") == ("local", "hub")
    with pytest.raises(ticks.TickError):
        ticks.normalize_source("elsewhere")


def test_append_keeps_keys_unique(spark, tmp_path):
    root = str(tmp_path)
    ticks.append_new(trades(spark), root, "trades")
    ticks.append_new(trades(spark, 60), root, "trades")
    assert spark.read.parquet(f"{root}/trades").count() == 60
    assert ticks.compact(spark, root, "trades", str(tmp_path / "new")) == 60
    assert ticks.range_export(spark, root, "trades", DAY, DAY + 600_000, str(tmp_path / "x"))["rows"] == 10
    assert ticks.prune_days(spark, root, "trades", ["2024-01-01", "2024-01-02"]) == ["2024-01-01"]


def test_vendor_csv(spark, tmp_path):
    body = "1,10.5,2,1,1,1704067200000,true\n2,10.6,1,2,2,1704067201000,false\n"
    (tmp_path / "a.csv").write_text(body)
    (tmp_path / "b.csv").write_text(",".join(ticks.VENDOR_NAMES) + "\n" + body)
    for f in "ab":
        got = ticks.read_vendor_csv(spark, str(tmp_path / f"{f}.csv"), "v", "X").orderBy("trade_id").collect()
        assert [r["aggressor_buy"] for r in got] == [False, True] and got[0]["price"] == 10.5
    with pytest.raises(ticks.TickError):
        ticks.check_columns("1,2,3", False)
    with pytest.raises(ticks.TickError):
        ticks.check_columns("a,b,c,d,e,f,g", True)


def test_plans_and_paths():
    days = [f"2024-01-{d:02d}" for d in range(1, 32)] + ["2024-02-01"]
    assert ticks.plan_granularity(days, "auto", "2024-02-10") == [("monthly", "2024-01"), ("daily", "2024-02-01")]
    assert ticks.seam(None, 5) == "unknown" and ticks.seam(4, 5) == "ok" and ticks.seam(3, 5) == "gap" and ticks.seam(5, 5) == "overlap"
    assert ticks.archive_path("/r", "2024-01-01", "v", "X").endswith("v/X/aggTrades/date=2024-01-01/trades.parquet")
    with pytest.raises(ticks.TickError):
        ticks.archive_path("/r", "2024-01-01", "../v", "X")
    assert ticks.days_between(DAY, DAY + 1) == ["2024-01-01"] and not ticks.day_is_closed("2024-01-01", DAY + 86_400_000)


def test_ledgers_and_cache(spark, tmp_path):
    row = {"date": "2024-01-01", "o": 1.0, "h": 2.0, "l": 0.5, "c": 1.5, "poc": 1.0, "vah": 1.5, "val": 0.8, "vol": 10.0}
    path = str(tmp_path / "levels")
    assert ticks.append_levels(row, spark, path) and not ticks.append_levels(row, spark, path)
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert ticks.cached(spark, str(tmp_path / "c"), {"a": 1}, build).count() == 3
    assert len(built) == 1 and ticks.spec_hash({"a": 1}) != ticks.spec_hash({"a": 2})


def test_one_symbol(spark):
    t = trades(spark)
    ticks.require_one_symbol(t)
    with pytest.raises(ticks.TickError):
        ticks.require_one_symbol(t.unionByName(t.withColumn("symbol", F.lit("Y"))))


def test_asof_by_brute_force(spark, data):
    t = tape(spark, data)
    a = t.filter("exchange = 'click'").select("symbol", "trade_id", "ts_ms")
    b = t.filter("exchange = 'view'").select("symbol", F.col("ts_ms").alias("q_ms"), "price")
    left, right = a.collect(), b.collect()
    for forward in (False, True):
        for strict in (False, True):
            got = {r["trade_id"]: r["q_ms"] for r in asof_join(a, b.unionByName(a.limit(3).select("symbol", F.col("ts_ms").alias("q_ms"), F.lit(0.0).alias("price"))), ["symbol"], "ts_ms", "q_ms", forward=forward, strict=strict).collect()}
            extra = [r["q_ms"] for r in right] + [r["ts_ms"] for r in a.limit(3).collect()]
            for r in left:
                ok = [q for q in extra if (q > r["ts_ms"] if forward else q < r["ts_ms"]) or (q == r["ts_ms"] and not strict)]
                assert got[r["trade_id"]] == ((min if forward else max)(ok) if ok else None)
