"""Rows of one instant are taken in the order of their ids, as a stable sort of the record leaves them; no window looks ahead from every row."""

from datetime import datetime, timedelta

import pytest

from tests.oracle import compare, connect
from tidemark.plans.catalog import ORACLES, QUERIES


@pytest.fixture
def tied(spark, tmp_path):
    """Events in order of time, four to a millisecond for each type; ids gain digits and values do not follow them."""
    import duckdb

    kinds = ["click", "view", "purchase"]
    rows = [(i, datetime(2024, 1, 1, 22) + timedelta(microseconds=i // 12 * 60_000_000 + i % 12 * 80), i * 7 % 11, kinds[i % 3], float(i * i * 37 % 101) + 0.25, '{"k": 1}') for i in range(2, 3000)]
    con = duckdb.connect()
    con.sql("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.sql(f"COPY (SELECT * FROM e ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return str(tmp_path)


def of_tied(spark, tied, name):
    con = connect(tied)
    con.sql("SET threads = 1")
    return compare(spark, con, QUERIES[name], ORACLES[name], tied)


def test_markout(spark, tied):
    assert of_tied(spark, tied, "markout") == ""
    plan = QUERIES["markout"](spark, tied)._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_asof_backward(spark, tied):
    assert of_tied(spark, tied, "asof_backward") == ""


def test_asof_forward(spark, tied):
    assert of_tied(spark, tied, "asof_forward") == ""


@pytest.mark.parametrize("name", ["roll_spread", "autocovariances", "roll_bounds"])
def test_any_order_of_the_files(spark, tied, tmp_path_factory, name):
    """The SQL reads the record in its order, in one thread; the query reads it turned round."""
    turned = tmp_path_factory.mktemp("turned")
    con = connect(tied)
    con.sql("SET threads = 1")
    con.sql(f"COPY (SELECT * FROM events ORDER BY event_id DESC) TO '{turned}/events.parquet' (FORMAT parquet)")
    for path in (tied, str(turned)):
        assert compare(spark, con, QUERIES[name], ORACLES[name], path) == ""


@pytest.mark.parametrize("name", ["autocovariances", "roll_bounds"])
def test_one_frame_for_all_lags(spark, tied, name):
    """A lag() for each of them read the series again and ran out of heap on spilled ones."""
    plan = QUERIES[name](spark, tied)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(_e" not in plan and plan.count("collect_list(_e") == 1


def test_autocovariances_exactly(spark, tied):
    """Cents as integers in the order of time and id, no window and no float; a series of three prints has fewer changes than lags."""
    from fractions import Fraction

    from pyspark.sql import functions as F

    from tidemark.functions.windows import by
    from tidemark.operators import micro
    from tidemark.plans.pricing import _changes
    from tidemark.sources.schemas import tape

    rows = tape(spark, tied).select("exchange", "ts_ms", F.col("trade_id").cast("long"), "price").collect()
    few = spark.createDataFrame([("few", 1, 1, 1.0), ("few", 2, 2, 3.0), ("few", 3, 3, 8.0)], "series string, ts long, id long, p double")
    d = _changes(spark, tied).select("series", "ts", "dp")
    got = {r["series"]: r for r in micro.autocovariances(d, 10).collect()}
    assert sorted(got) == ["click", "purchase", "view"]
    for s, r in got.items():
        cents = [round(v * 100) for _, _, v in sorted(tuple(x)[1:] for x in rows if x[0] == s)]
        dp = [b - a for a, b in zip(cents, cents[1:])]
        mu = Fraction(sum(dp), len(dp))
        e = [x - mu for x in dp]
        assert r["n"] == len(dp)
        for k in range(11):
            assert r["g"][k] == pytest.approx(float(sum(a * b for a, b in zip(e[k:], e)) / len(dp) / 10000), rel=1e-9, abs=1e-9)
    short = micro.autocovariances(few.withColumn("dp", F.col("p") - F.lag("p").over(by("series", "ts"))), 10).first()
    assert short["n"] == 2 and short["g"] == [2.25, -1.125] + [0.0] * 9


@pytest.mark.parametrize("odd", ["no name", "no time", "few"])
def test_autocovariances_of_odd_records(spark, tied, tmp_path, odd):
    """A venue without a name is a series, prints without a time come last, and a lag longer than the series is NULL."""
    import duckdb

    out = tmp_path / "odd"
    out.mkdir()
    some = {
        "no name": "SELECT * REPLACE (nullif(event_type, 'view') AS event_type) FROM e",
        "no time": "SELECT * REPLACE (CASE WHEN event_id % 50 <> 7 THEN ts END AS ts) FROM e",
        "few": "SELECT * FROM e UNION ALL SELECT 9000 + i, TIMESTAMP '2024-01-20' + to_seconds(i), 1, 'few' || k, i * i % 7 + 0.25, '{\"k\": 1}' FROM range(1, 6) r(k), range(0, 5) q(i) WHERE i < k",
    }[odd]
    duckdb.sql(f"COPY (WITH e AS (SELECT * FROM '{tied}/events.parquet') FROM ({some}) ORDER BY ts NULLS LAST, event_id) TO '{out}/events.parquet' (FORMAT parquet)")
    assert of_tied(spark, str(out), "autocovariances") == ""
