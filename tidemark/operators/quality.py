"""Data-quality gates: keys, order, gaps, holes, containment, coverage, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import previous
from tidemark.sources.schemas import DAY_MS


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that repeat, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_summary(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """dup_keys and surplus rows for each value of by (columns of keys)."""
    return duplicates(df, keys).groupBy(*by).agg(F.count("*").alias("dup_keys"), F.sum(F.col("n") - 1).alias("surplus"))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def bad_values(trades: DataFrame) -> DataFrame:
    """Counts of NULL, NaN and non-positive prices and sizes by venue."""
    odd = lambda c, t: F.count(F.when(t, 1)).alias(c)
    cols = []
    for c in ("price", "qty"):
        x = F.col(c)
        cols += [odd(f"{c}_null", x.isNull()), odd(f"{c}_nan", F.isnan(x)), odd(f"{c}_not_positive", ~F.isnan(x) & (x <= 0))]
    return trades.groupBy("exchange").agg(F.count("*").alias("n"), *cols)


def inversions(df: DataFrame, arrival: str, keys: list[str]) -> DataFrame:
    """Rows whose time is before that of the row that arrived before; arrival is a number, sorted in chunks of a million."""
    return previous(df, "_b", "ts_ms", keys, arrival, 1_000_000).groupBy(*keys).agg(F.count(F.when(F.col("ts_ms") < F.col("_b"), 1)).alias("inversions"), F.max(F.col("_b") - F.col("ts_ms")).alias("worst_ms"))


def gap_stats(df: DataFrame, gap_ms: int) -> DataFrame:
    """By venue: number, longest and summed gaps longer than gap_ms, and the 95th percentile of spacing."""
    s = previous(df, "_b", "ts_ms", ["exchange"]).select("exchange", (F.col("ts_ms") - F.col("_b")).alias("step")).filter("step is not null")
    big = F.when(F.col("step") > gap_ms, F.col("step"))
    return s.groupBy("exchange").agg(F.count(big).alias("gaps"), F.max(big).alias("longest"), F.coalesce(F.sum(big), F.lit(0)).alias("total"), F.percentile("step", F.lit(0.95)).alias("p95"))


def id_holes(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Runs of missing ids, as first and last missing."""
    d = previous(df.select(*keys, id_col).distinct(), "_n", id_col, keys, id_col, 1_000_000, ahead=True)
    return d.filter(F.col("_n") > F.col(id_col) + 1).select(*keys, (F.col(id_col) + 1).alias("first_missing"), (F.col("_n") - 1).alias("last_missing"))


def id_continuity(df: DataFrame, id_col: str) -> DataFrame:
    """By venue and day: id span, missing ids inside, and the step from the day before (days may be skipped)."""
    g = df.withColumn("day", F.floor(F.col("ts_ms") / DAY_MS).cast("long")).groupBy("exchange", "day").agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.countDistinct(id_col).alias("n"))
    w = Window.partitionBy("exchange").orderBy("day")
    return g.withColumns({"missing": F.col("hi") - F.col("lo") + 1 - F.col("n"), "seam": F.col("lo") - F.lag("hi").over(w), "adjacent": F.col("day") - F.lag("day").over(w) == 1})


def outside_day(df: DataFrame, day: Column) -> DataFrame:
    """Rows whose time is not inside the day of their partition, by that day."""
    off = F.floor(F.col("ts_ms") / DAY_MS).cast("long") != day
    return df.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.count(F.when(off, 1)).alias("outside"))


def hourly_coverage(df: DataFrame, cadence_ms: int) -> DataFrame:
    """Share of each hour covered: every row covers the time to the next, cadence_ms at most; on from 0.9, off under 0.1."""
    hour = 3_600_000
    df = previous(df, "_next", "ts_ms", ["exchange"], ahead=True)
    end = F.coalesce("_next", F.col("ts_ms") + cadence_ms)
    d = df.select("exchange", F.floor(F.col("ts_ms") / hour).cast("long").alias("hour"), F.least(end - F.col("ts_ms"), F.lit(cadence_ms)).alias("ms"))
    g = d.groupBy("exchange", "hour").agg((F.sum("ms") / hour).alias("covered"))
    return g.withColumn("state", F.when(F.col("covered") >= 0.9, "on").when(F.col("covered") < 0.1, "off").otherwise("partial"))


def census(df: DataFrame, cadence_ms: int, first_day: int, days: int) -> DataFrame:
    """Hours by state for each venue and day of a fixed grid; hours without rows are off."""
    spark = df.sparkSession
    grid = df.select("exchange").distinct().crossJoin(F.broadcast(spark.range(first_day * 24, (first_day + days) * 24).withColumnRenamed("id", "hour")))  # days fix the grid's size
    g = grid.join(hourly_coverage(df, cadence_ms), ["exchange", "hour"], "left").withColumn("state", F.coalesce("state", F.lit("off")))
    by = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return g.groupBy("exchange", F.floor(F.col("hour") / 24).cast("long").alias("day")).agg(by("on"), by("partial"), by("off"))


def inventory(df: DataFrame) -> DataFrame:
    return df.groupBy("exchange").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), (F.count("*") * 60_000.0 / (F.max("ts_ms") - F.min("ts_ms"))).alias("per_minute"))


def several_symbols(df: DataFrame) -> DataFrame:
    """Venues with more than one instrument: never to be pooled."""
    return df.groupBy("exchange").agg(F.countDistinct("symbol").alias("symbols")).filter("symbols > 1")


def manifest(df: DataFrame) -> DataFrame:
    """day, rows, ts_min, ts_max."""
    return df.groupBy(F.floor(F.col("ts_ms") / DAY_MS).cast("long").alias("day")).agg(F.count("*").alias("rows"), F.min("ts_ms").alias("ts_min"), F.max("ts_ms").alias("ts_max"))


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either manifest that the other lacks; empty when they match."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def table_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: keys only in a, only in b, in both, and for each field how many of those differ."""
    j = a.select(F.col(key), *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("_a")).join(b.select(F.col(key), *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(1).alias("_b")), key, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"), F.count(F.when(both, 1)).alias("both"),
        *[F.count(F.when(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), 1)).alias(f"diff_{f}") for f in fields],
    )


def bursts(df: DataFrame, gap_ms: int, keys: list[str]) -> DataFrame:
    """Sessions: events no more than gap_ms apart.

    As in `bars.holes`, a cell of that width lies in one session: first, last and count by cell are enough to find them.
    """
    cells = df.groupBy(*keys, F.floor(F.col("ts_ms") / max(gap_ms, 1)).alias("_cell")).agg(F.min("ts_ms").alias("_a"), F.max("ts_ms").alias("_z"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_cell")
    d = cells.withColumn("_new", (F.col("_a") - F.lag("_z").over(w) > gap_ms).cast("int"))
    d = d.withColumn("session", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long"))
    return d.groupBy(*keys, "session").agg(F.min("_a").alias("first_ms"), F.max("_z").alias("last_ms"), F.sum("_n").alias("n"))


def quiet_periods(sessions_df: DataFrame, keys: list[str]) -> DataFrame:
    """Hours from the end of a session to the start of the next."""
    w = Window.partitionBy(*keys).orderBy("session")
    return sessions_df.withColumn("quiet_h", (F.lead("first_ms").over(w) - F.col("last_ms")) / 3_600_000).filter("quiet_h is not null").select(*keys, "session", "quiet_h")


def overlapping_extent(archived: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted extent (name, lo, hi) the first archived extent (name, a_lo, a_hi) that overlaps it."""
    j = wanted.join(archived, "name").filter((F.col("a_lo") <= F.col("hi")) & (F.col("lo") <= F.col("a_hi")))
    return j.groupBy("name", "lo", "hi").agg(F.min(F.struct("a_lo", "a_hi")).alias("x")).select("name", "lo", "hi", "x.a_lo", "x.a_hi")


def minute_coherence(trades: DataFrame, a: str, b: str, minute_ms: int = 60_000) -> DataFrame:
    """Two venues' mean prices by minute: median and 95th percentile of the difference in basis points, and how often they move alike."""
    m = trades.filter(F.col("exchange").isin(a, b)).groupBy("exchange", F.floor(F.col("ts_ms") / minute_ms).cast("long").alias("minute")).agg(F.avg("price").alias("p"))
    w = Window.partitionBy("exchange").orderBy("minute")
    m = m.withColumn("up", F.signum(F.col("p") - F.lag("p").over(w)))
    x, y = (m.filter(F.col("exchange") == e).select("minute", F.col("p").alias(f"p{k}"), F.col("up").alias(f"u{k}")) for e, k in ((a, 1), (b, 2)))
    bp = F.abs(F.try_divide(F.col("p1") - F.col("p2"), F.col("p2"))) * 10_000
    return x.join(y, "minute").agg(F.count("*").alias("minutes"), F.percentile(bp, F.lit(0.5)).alias("p50"), F.percentile(bp, F.lit(0.95)).alias("p95"), F.avg((F.col("u1") == F.col("u2")).cast("double")).alias("agree"))
