"""The tick store: day-partitioned Parquet, read with date bounds taken from time bounds, written through gates.

<root>/<table>/date=YYYY-MM-DD/*.parquet, each day sorted by ts_ms so that row-group statistics prune.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.schemas import DAY_MS, TABLES, UNIQUE

#: Columns of the vendor's csv, in order.
VENDOR = "agg_trade_id bigint, price double, quantity double, first_trade_id bigint, last_trade_id bigint, transact_time bigint, is_buyer_maker boolean"
VENDOR_NAMES = [c.split()[0] for c in VENDOR.split(", ")]
#: Sources by precedence: the first that has a day gives it.
PRECEDENCE = ("local", "hub", "archive")
SAFE = re.compile(r"^[A-Za-z0-9_.-]+$")
BARS_VERSION = 1


class TickError(ValueError):
    """A refused input."""


def day_of(ms: int) -> str:
    return (dt.date(1970, 1, 1) + dt.timedelta(days=ms // DAY_MS)).isoformat()


def days_between(start_ms: int, end_ms: int) -> list[str]:
    """UTC dates that [start, end) touches."""
    return [day_of(d * DAY_MS) for d in range(start_ms // DAY_MS, -(-end_ms // DAY_MS))]


def day_is_closed(day: str, now_ms: int, grace_ms: int = 360_000) -> bool:
    end = (dt.date.fromisoformat(day) - dt.date(1970, 1, 1)).days * DAY_MS + DAY_MS
    return end + grace_ms <= now_ms


def archive_path(root: str, day: str, venue: str, symbol: str, family: str = "aggTrades", table: str = "trades") -> str:
    """venue/symbol/family/date=D/table.parquet, every part checked."""
    for part in (venue, symbol, family, table):
        if not SAFE.match(part):
            raise TickError(f"bad path part {part!r}")
    dt.date.fromisoformat(day)
    return f"{root.rstrip('/')}/{venue}/{symbol}/{family}/date={day}/{table}.parquet"


def normalize_source(source: str | Iterable[str]) -> tuple[str, ...]:
    """auto is what was recorded (local and hub); names come back in order of precedence."""
    names = {source} if isinstance(source, str) else set(source)
    if "auto" in names:
        names = (names - {"auto"}) | {"local", "hub"}
    if bad := names - set(PRECEDENCE):
        raise TickError(f"unknown source {sorted(bad)}")
    return tuple(s for s in PRECEDENCE if s in names)


def projection(table: str) -> list[str]:
    return TABLES[table].fieldNames()


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def symbol_filter(symbols: dict[str, str]) -> Column:
    """Rows of a named venue must be of its instrument; other venues pass."""
    out = ~F.col("exchange").isin(list(symbols)) if symbols else F.lit(True)
    for venue, symbol in symbols.items():
        out = out | ((F.col("exchange") == venue) & (F.col("symbol") == symbol))
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def partition_days(spark: SparkSession, root: str, table: str) -> list[str]:
    """Dates of the day folders of a table, from the file system's listing alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n[5:] for n in names if n.startswith("date="))


def resolve_days(spark: SparkSession, roots: dict[str, str], table: str, days: list[str]) -> dict[str, str]:
    """The source of each wanted day that some source has, by precedence."""
    have = {s: set(partition_days(spark, roots[s], table)) for s in normalize_source(roots)}
    return {d: next(s for s in have if d in have[s]) for d in days if any(d in h for h in have.values())}


def read_ticks(spark: SparkSession, roots: dict[str, str] | str, table: str, start_ms: int, end_ms: int, exchanges: list[str] | None = None, symbols: dict[str, str] | None = None) -> DataFrame:
    """Rows of [start, end): whole days are chosen by folder, the rest is pushed down to the files. Column source says where a row comes from."""
    roots = {"local": roots} if isinstance(roots, str) else roots
    out = None
    found = resolve_days(spark, roots, table, days_between(start_ms, end_ms))
    for source in dict.fromkeys(found.values()):
        paths = [f"{roots[source]}/{table}/date={d}" for d, s in found.items() if s == source]
        part = spark.read.schema(TABLES[table]).parquet(*paths).select(*projection(table), F.lit(source).alias("source"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = empty(spark, table).withColumn("source", F.lit(None).cast("string"))
    out = out.filter((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    if exchanges:
        out = out.filter(F.col("exchange").isin(exchanges))
    return out.filter(symbol_filter(symbols)) if symbols else out


def available_days(spark: SparkSession, roots: dict[str, str], table: str) -> DataFrame:
    """date, source, rows of every stored day."""
    out = None
    for source in normalize_source(roots):
        if partition_days(spark, roots[source], table):
            part = spark.read.option("basePath", f"{roots[source]}/{table}").parquet(f"{roots[source]}/{table}").groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("rows")).withColumn("source", F.lit(source))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "date string, rows long, source string")


def require_one_symbol(trades: DataFrame) -> DataFrame:
    """Refuse a venue with several instruments."""
    bad = trades.groupBy("exchange").agg(F.countDistinct("symbol").alias("n")).filter("n > 1").limit(5).collect()
    if bad:
        raise TickError(f"several instruments on {[r['exchange'] for r in bad]}")
    return trades


def gate(df: DataFrame, table: str, day: str) -> dict:
    """One pass over a day before it is written: refuses no rows, times that are not milliseconds, rows of other days and repeated keys."""
    keys = UNIQUE.get(table)
    start = (dt.date.fromisoformat(day) - dt.date(1970, 1, 1)).days * DAY_MS
    g = df.agg(F.count("*").alias("rows"), F.min("ts_ms").alias("ts_min"), F.max("ts_ms").alias("ts_max"), F.count(F.when(~F.col("ts_ms").between(start, start + DAY_MS - 1) | F.col("ts_ms").isNull(), 1)).alias("outside")).first().asDict()
    if not g["rows"]:
        raise TickError(f"{day}: no rows")
    if not 10**12 <= g["ts_max"] < 10**13:
        raise TickError(f"{day}: times are not in milliseconds")
    if g["outside"]:
        raise TickError(f"{day}: {g['outside']} rows of other days")
    if keys and (dup := df.groupBy(*keys).count().filter("count > 1").count()):
        raise TickError(f"{day}: {dup} keys repeat")
    return {"rows": g["rows"], "ts_min": g["ts_min"], "ts_max": g["ts_max"]}


def write_day(df: DataFrame, root: str, table: str, day: str) -> dict:
    """Gate a day, write it sorted by time as ZSTD Parquet, read it again and compare. Returns its manifest row."""
    spark = df.sparkSession
    want = gate(df, table, day)
    path = f"{root}/{table}/date={day}"
    df.select(*projection(table)).repartitionByRange("ts_ms").sortWithinPartitions("ts_ms").write.mode("overwrite").option("compression", "zstd").parquet(path)
    got = spark.read.schema(TABLES[table]).parquet(path).agg(F.count("*").alias("rows"), F.min("ts_ms").alias("ts_min"), F.max("ts_ms").alias("ts_max")).first().asDict()
    if got != want:
        raise TickError(f"{day}: wrote {want}, read {got}")
    return {"table": table, "date": day} | got


def append_new(df: DataFrame, root: str, table: str) -> DataFrame:
    """Rows whose key the store does not have are appended by day; rows of a table without a key all are. Returns what was added."""
    spark = df.sparkSession
    keys = UNIQUE.get(table)
    new = df.select(*projection(table))
    if keys:
        new = new.dropDuplicates(list(keys))
        if _exists(spark, f"{root}/{table}"):
            new = new.join(spark.read.parquet(f"{root}/{table}").select(*keys), list(keys), "left_anti")
    new = new.withColumn("date", F.date_format(F.date_from_unix_date(F.floor(F.col("ts_ms") / DAY_MS).cast("int")), "yyyy-MM-dd"))
    new.repartition("date").sortWithinPartitions("ts_ms").write.mode("append").partitionBy("date").option("compression", "zstd").parquet(f"{root}/{table}")
    return new


def sniff_header(first_line: str) -> bool:
    """True if the first field is no whole number."""
    return not first_line.split(",")[0].strip().lstrip("-").isdigit()


def check_columns(first_line: str, header: bool) -> None:
    fields = [f.strip() for f in first_line.rstrip("\r\n").split(",")]
    if len(fields) != len(VENDOR_NAMES):
        raise TickError(f"{len(fields)} columns, not {len(VENDOR_NAMES)}")
    if header and fields != VENDOR_NAMES:
        raise TickError(f"unknown columns {fields}")


def read_vendor_csv(spark: SparkSession, path: str, venue: str, symbol: str) -> DataFrame:
    """Vendor prints as trades; types and header are declared, and a row that does not fit fails."""
    first = spark.read.text(path).first()
    if first is None:
        raise TickError(f"{path}: no rows")
    header = sniff_header(first[0])
    check_columns(first[0], header)
    d = spark.read.schema(VENDOR).option("header", header).option("mode", "FAILFAST").csv(path)
    return d.select(F.lit(venue).alias("exchange"), F.lit(symbol).alias("symbol"), F.col("agg_trade_id").cast("string").alias("trade_id"), F.col("transact_time").alias("ts_ms"), "price", F.col("quantity").alias("qty"), (~F.col("is_buyer_maker")).alias("aggressor_buy"))


def ingest(df: DataFrame, root: str, table: str, days: list[str]) -> list[dict]:
    """A month's or a day's rows, split into gated days."""
    out = []
    for day in days:
        start = (dt.date.fromisoformat(day) - dt.date(1970, 1, 1)).days * DAY_MS
        out.append(write_day(df.filter(F.col("ts_ms").between(start, start + DAY_MS - 1)), root, table, day))
    return out


def plan_granularity(days: list[str], granularity: str, today: str) -> list[tuple[str, str]]:
    """(monthly|daily, key): whole past months as one object where granularity is auto or monthly, single days else."""
    if granularity not in ("auto", "daily", "monthly"):
        raise TickError(f"unknown granularity {granularity!r}")
    out, months = [], {}
    for d in sorted(set(days)):
        months.setdefault(d[:7], []).append(d)
    for m, own in months.items():
        y, k = map(int, m.split("-"))
        whole = len(own) == (dt.date(y + k // 12, k % 12 + 1, 1) - dt.date(y, k, 1)).days and m < today[:7]
        if granularity == "monthly" or (granularity == "auto" and whole):
            out.append(("monthly", m))
        else:
            out += [("daily", d) for d in own]
    return out


def seam(previous_last_id: int | None, first_id: int) -> str:
    """How a day's first id follows the day before's last."""
    if previous_last_id is None:
        return "unknown"
    return "ok" if first_id == previous_last_id + 1 else "gap" if first_id > previous_last_id + 1 else "overlap"


def range_export(spark: SparkSession, root: str, table: str, start_ms: int, end_ms: int, dest: str) -> dict:
    """Rows of [start, end) as one sorted export; counts and bounds are read again."""
    src = read_ticks(spark, root, table, start_ms, end_ms).drop("source")
    want = src.agg(F.count("*"), F.min("ts_ms"), F.max("ts_ms")).first()
    src.repartitionByRange("ts_ms").sortWithinPartitions("ts_ms").write.mode("overwrite").option("compression", "zstd").parquet(dest)
    got = spark.read.parquet(dest).agg(F.count("*"), F.min("ts_ms"), F.max("ts_ms")).first()
    if tuple(got) != tuple(want):
        raise TickError(f"exported {tuple(want)}, read {tuple(got)}")
    return {"rows": got[0], "ts_min": got[1], "ts_max": got[2]}


def prune_days(spark: SparkSession, root: str, table: str, days: list[str]) -> list[str]:
    """Delete day folders; returns those that were there."""
    gone = []
    for d in days:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/date={d}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.delete(path, True):
            gone.append(d)
    return gone


def compact(spark: SparkSession, root: str, table: str, dest: str) -> int:
    """Copy a table into few sorted files a day below another root; counts must agree."""
    src = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    n = src.count()
    src.repartition("date").sortWithinPartitions("date", "ts_ms").write.mode("overwrite").partitionBy("date").option("compression", "zstd").parquet(f"{dest}/{table}")
    if (m := spark.read.parquet(f"{dest}/{table}").count()) != n:
        raise TickError(f"copied {m} of {n} rows")
    return n


def closed_months(df: DataFrame, now_ms: int) -> DataFrame:
    """Months with rows that have wholly passed."""
    month = F.date_format(F.date_from_unix_date(F.floor(F.col("ts_ms") / DAY_MS).cast("int")), "yyyy-MM")
    return df.select(month.alias("month")).distinct().filter(F.col("month") < day_of(now_ms)[:7])


def append_json(rows: list[dict], spark: SparkSession, path: str, schema: str) -> None:
    """Append ledger rows as JSON lines."""
    spark.createDataFrame([tuple(r.get(f.split()[0]) for f in schema.split(", ")) for r in rows], schema).coalesce(1).write.mode("append").json(path)


def append_levels(row: dict, spark: SparkSession, path: str) -> bool:
    """Append a day's levels unless that date is there."""
    schema = "date string, o double, h double, l double, c double, poc double, vah double, val double, vol double"
    if _exists(spark, path) and not spark.read.schema(schema).json(path).filter(F.col("date") == row["date"]).isEmpty():
        return False
    append_json([row], spark, path, schema)
    return True


def spec_hash(spec: dict) -> str:
    """16 hexadecimal digits of a request and the version of its formulas."""
    return hashlib.sha256(json.dumps(spec | {"version": BARS_VERSION}, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, spec: dict, build, final: bool = True) -> DataFrame:
    """The stored result of a request, or build() stored under its hash; results that are not final are not stored."""
    path = f"{root}/{spec_hash(spec)}"
    if _exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    df = build()
    if not final:
        return df
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
