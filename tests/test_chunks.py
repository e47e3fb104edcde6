"""Operators that pass little from one chunk of time to the next, against plain loops over the whole history."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.windows import nearest_rank, overlapped, previous, spaced
from tidemark.operators import bars, quality


def prints(seed: int, n: int, span: int):
    r = random.Random(seed)
    return [(e, f"{i:05d}", r.randrange(span), float(r.randrange(4)), float(r.randrange(1, 9)), r.random() < 0.1) for e in "ab" for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "exchange string, trade_id string, ts_ms long, price double, qty double, turn boolean")


@pytest.mark.parametrize("seed, ms, span, reset", [(1, 5, 300, None), (2, 40, 300, None), (3, 1, 60, "turn"), (4, 25, 2000, "turn"), (5, 333, 2000, None)])
def test_spaced(spark, seed, ms, span, reset):
    rows = prints(seed, 150, span)
    got = {(r["exchange"], r["trade_id"]): (r["kept"], r["start_ms"], r["start_id"]) for r in spaced(frame(spark, rows), ms, ["exchange"], reset, chunk=50).collect()}
    for e in "ab":
        last = None
        for x in sorted((x for x in rows if x[0] == e), key=lambda x: (x[2], x[1])):
            keep = last is None or x[2] >= last[0] + ms or (reset is not None and x[5])
            last = (x[2], x[1]) if keep else last
            assert got[e, x[1]] == (keep, *last)


def test_spaced_without_rows(spark):
    assert spaced(frame(spark, []), 5, ["exchange"]).count() == 0
    assert spaced(frame(spark, [("a", "1", None, 1.0, 1.0, False)]), 5, ["exchange"]).count() == 0


@pytest.mark.parametrize("ahead", [False, True])
def test_previous_keeps_null_values(spark, ahead):
    rows = [("a", f"{t:05d}", t, None if t % 3 else float(t), 1.0, False) for t in range(0, 400, 7)]
    got = {r["ts_ms"]: r["x"] for r in previous(frame(spark, rows), "x", "price", ["exchange"], chunk=50, ahead=ahead).collect()}
    for i, r in enumerate(rows):
        j = i + 1 if ahead else i - 1
        assert got[r[2]] == (rows[j][3] if 0 <= j < len(rows) else None)


def test_overlapped_windows(spark):
    from pyspark.sql import Window

    rows = prints(6, 120, 900)
    w = Window.partitionBy("exchange", "_chunk").orderBy("ts_ms").rangeBetween(-29, 0)
    got = overlapped(frame(spark, rows), 30, chunk=50).withColumn("s", F.sum("qty").over(w)).filter("_own").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["s"] == sum(x[4] for x in rows if x[0] == r["exchange"] and r["ts_ms"] - 30 < x[2] <= r["ts_ms"])


@pytest.mark.parametrize("n, p", [(1, 0.5), (20, 0.95), (21, 0.95), (500, 0.95), (7, 1.0)])
def test_nearest_rank(spark, n, p):
    import math

    r = random.Random(n)
    values = [round(r.lognormvariate(3, 2), 1) - 1 for _ in range(n)]
    d = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("a", float("nan"))], "k string, x double")
    got = nearest_rank(d, "x", p, ["k"], "q").collect()
    assert [x["q"] for x in got] == [sorted(values)[math.ceil(n * p) - 1]]


def test_holes_and_bursts(spark):
    rows = prints(7, 60, 3000)
    d = frame(spark, rows)
    got = {(r["exchange"], r["h0"], r["h1"]) for r in bars.holes(d, 100, 2900, 40).collect()}
    groups = {(r["exchange"], r["session"], r["first_ms"], r["last_ms"], r["n"]) for r in quality.bursts(d, 40, ["exchange"]).collect()}
    want, runs = set(), set()
    for e in "ab":
        t = sorted(x[2] for x in rows if x[0] == e)
        inside = [100, *[x for x in t if 100 <= x < 2900], 2900]
        want |= {(e, a, b) for a, b in zip(inside, inside[1:]) if b - a > 40}
        cuts = [0, *[i for i in range(1, len(t)) if t[i] - t[i - 1] > 40], len(t)]
        runs |= {(e, k, t[a], t[b - 1], b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert got == want
    assert groups == runs
