"""Window helpers that keep warm-up rows NULL and never look ahead."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by(series: list[str] | str, order: list | str) -> WindowSpec:
    series = [series] if isinstance(series, str) else series
    order = [order] if isinstance(order, str) else order
    return Window.partitionBy(*series).orderBy(*order)


def rolling(agg, x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, NULL until `least` (n) of them are not NULL."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def prior(agg, x: Column, w: WindowSpec, n: int) -> Column:
    """agg over the n rows before this one, NULL until all are there."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def running(agg, x: Column, w: WindowSpec) -> Column:
    return agg(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def average_rank(x: Column, series: list[str]) -> Column:
    """Ranks from 1, ties sharing their mean."""
    own = Window.partitionBy(*series)
    return F.rank().over(own.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*series, x)) - 1) / 2.0


def islands(flag: Column, w: WindowSpec) -> Column:
    """Number of the run of consecutive true rows, from 0; NULL on other rows."""
    start = flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    number = F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return F.when(flag, number.cast("long"))


def sessions(ts: Column, w: WindowSpec, gap: int) -> Column:
    """Number of the session of rows no more than gap apart, from 0."""
    return (F.sum(F.when(ts - F.lag(ts).over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long")


def ewm(x: Column, w: WindowSpec, alpha: float, least: int, tail: float = 1e-15) -> Column:
    """Exponential mean, weights by position and without adjustment, begun at the first value.

    Weights further back than `tail` are left out, so a row looks at a bounded number of others; the first
    value keeps its full weight while it is inside that reach. NULL until `least` values are there; a
    NULL inside decays what came before it and gives the last mean again.
    """
    import math

    reach = max(1, math.ceil(math.log(tail) / math.log(1 - alpha))) if alpha < 1 else 1
    frame = w.rowsBetween(-reach, 0)
    values = F.collect_list(F.struct(F.coalesce(x, F.lit(float("nan"))).alias("v"))).over(frame)
    begin = F.struct(F.lit(None).cast("double").alias("m"), F.lit(1.0).alias("old"))

    def step(acc: Column, item: Column) -> Column:
        v, m, old = item["v"], acc["m"], acc["old"] * (1 - alpha)
        fresh = F.when(m.isNull(), v).otherwise((old * m + alpha * v) / (old + alpha))
        return F.when(F.isnan(v), F.struct(m.alias("m"), F.when(m.isNull(), F.lit(1.0)).otherwise(old).alias("old"))).otherwise(F.struct(fresh.alias("m"), F.lit(1.0).alias("old")))

    mean = F.aggregate(values, begin, step, lambda a: a["m"])
    seen = F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(seen >= least, mean)


def previous(df, name: str, value: str, keys: list[str], ts: str = "ts_ms", chunk: int = 86_400_000, ahead: bool = False, ties: tuple[str, ...] = ()):
    """Add name: value of the row before (after, if ahead) by time inside keys, without one sort of a key's whole history.

    Rows are sorted inside chunks of time; only each chunk's last (first) row crosses to the next chunk that
    has rows, through a table with one row for each key and chunk.
    """
    order = [ts, *ties]
    at = F.struct(*order)
    c = F.floor(F.col(ts) / chunk).cast("long")
    d = df.withColumn("_chunk", c)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    edge = (F.min_by if ahead else F.max_by)(value, at)
    edges = d.groupBy(*keys, "_chunk").agg(edge.alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    step = F.lead if ahead else F.lag
    edges = edges.select(*keys, "_chunk", step("_edge").over(across).alias("_edge"))
    d = d.withColumn("_inside", step(F.struct(F.col(value).alias("v"))).over(inside))  # the struct is NULL at the chunk's edge only
    return d.join(edges, [*keys, "_chunk"], "left").withColumn(name, F.when(F.col("_inside").isNull(), F.col("_edge")).otherwise(F.col("_inside.v"))).drop("_chunk", "_inside", "_edge")


def running_sums(df, sums: dict[str, Column], keys: list[str], ts: str = "ts_ms", ties: tuple[str, ...] = ("trade_id",), chunk: int = 86_400_000):
    """Add running sums by time inside keys: sums inside chunks of time plus the totals of the chunks before."""
    d = df.withColumn("_chunk", F.floor(F.col(ts) / chunk).cast("long")).withColumns({f"_v_{n}": x for n, x in sums.items()})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    totals = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(past), F.lit(0.0)).alias(f"_p_{n}") for n in sums])
    d = d.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(totals, [*keys, "_chunk"], "left")
    return d.withColumns({n: F.coalesce(f"_p_{n}", F.lit(0.0)) + F.coalesce(f"_i_{n}", F.lit(0.0)) for n in sums}).drop("_chunk", *[f"_{k}_{n}" for n in sums for k in "vip"])


def overlapped(df, ms: int, ts: str = "ts_ms", chunk: int = 86_400_000):
    """Each row in its chunk of time and again, as context, in the next one if a trailing window (now - ms, now] reaches over.

    Adds _chunk, by which such windows may be partitioned, and _own, false on the rows of context.
    """
    size = max(chunk, ms)
    own = F.floor(F.col(ts) / size).cast("long")
    d = df.withColumn("_home", own).withColumn("_chunk", F.explode_outer(F.sequence("_home", F.floor((F.col(ts) + (ms - 1)) / size).cast("long"))))
    return d.withColumn("_own", F.col("_chunk").eqNullSafe(F.col("_home"))).drop("_home")


def nearest_rank(df, x: str, p: float, keys: list[str], name: str):
    """By keys, the value of rank ceil(p n) among the known x, exactly: counts by narrow cells find the cell, counts by value the place in it."""
    known = df.filter(F.col(x).isNotNull() & ~F.isnan(x)).withColumn("_cell", F.when(F.col(x) > 0, F.floor(F.log2(x) * 4096)).otherwise(F.lit(-(1 << 40))).cast("long"))
    own = Window.partitionBy(*keys)
    below = own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = known.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    cells = cells.select(*keys, "_cell", "_n", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.ceil(F.sum("_n").over(own) * p).alias("_rank"))
    cell = cells.filter((F.col("_below") < F.col("_rank")) & (F.col("_below") + F.col("_n") >= F.col("_rank"))).drop("_n")
    values = known.join(cell, [*keys, "_cell"]).groupBy(*keys, F.col(x).alias(name)).agg(F.count("*").alias("_n"), F.first(F.col("_rank") - F.col("_below")).alias("_left"))
    upto = F.sum("_n").over(own.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_left")).groupBy(*keys).agg(F.min(name).alias(name))


def spaced(df, ms: int, keys: list[str], reset: str | None = None, ts: str = "ts_ms", tie: str = "trade_id", chunk: int = 86_400_000):
    """Add kept, start_ms and start_id: a row is kept if it is ms or more after the row kept last, or if reset is true; start is the row kept last.

    Such a chain runs through a key's whole history, but a chunk of time only passes on its last kept row. Each chunk is
    first reduced to a table of steps: for every time from which a row may be kept again, the row kept last at its
    end. The steps are followed through the chunks of a key, then each chunk is marked on its own. No task holds more
    than a chunk, or a key's steps (rows of a chunk's first ms, equal ends merged). Rows without a time are dropped.
    """
    import numpy as np
    import pandas as pd

    flag = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    d = df.filter(F.col(ts).isNotNull()).withColumns({"_chunk": F.floor(F.col(ts) / chunk).cast("long"), "_reset": flag})
    names = df.columns
    key_ddl = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def chain(g: pd.DataFrame):
        """Rows in order, the row kept next after each, and the first reset row."""
        g = g.sort_values([ts, tie], kind="stable").reset_index(drop=True)
        t, n = g[ts].to_numpy(np.int64), len(g)
        marks = np.flatnonzero(g["_reset"].to_numpy(bool))
        follow = np.append(marks, n)[np.searchsorted(marks, np.arange(n), "right")]
        return g, t, np.minimum(np.searchsorted(t, t + ms, "left"), follow), int(marks[0]) if len(marks) else n

    def steps(g: pd.DataFrame) -> pd.DataFrame:
        g, t, nxt, first = chain(g)
        n = len(g)
        end = np.where(nxt < n, nxt, np.arange(n))
        while (end[end] != end).any():
            end = end[end]
        reach = min(int(np.searchsorted(t, g["_chunk"].iloc[0] * chunk + ms, "left")) + 1, n, first + 1)
        entry = np.arange(reach)
        entry = entry[(entry == 0) | (t[entry] != t[entry - 1]) | (entry == first)]  # of rows at one time only the first can be entered
        stop = end[entry]
        last = np.append(stop[1:] != stop[:-1], True)
        entry, stop = entry[last], stop[last]
        out = g.loc[stop, [*keys, "_chunk"]].reset_index(drop=True)
        return out.assign(upto=np.where(entry >= first, np.iinfo(np.int64).max, t[entry]), end_ms=t[stop], end_id=g[tie].to_numpy()[stop])

    def follow(g: pd.DataFrame) -> pd.DataFrame:
        out, at, who = [], None, None
        for c, part in g.sort_values(["_chunk", "upto"]).groupby("_chunk", sort=True):
            out.append((c, at, who))
            u = part["upto"].to_numpy(np.int64)
            i = 0 if at is None else int(np.searchsorted(u, at + ms, "left"))
            if i < len(u):
                at, who = int(part["end_ms"].iloc[i]), part["end_id"].iloc[i]
        f = pd.DataFrame(out, columns=["_chunk", "_at", "_who"]).astype({"_at": "Int64"})
        return f.assign(**{k: g[k].iloc[0] for k in keys})[[*keys, "_chunk", "_at", "_who"]]

    def mark(g: pd.DataFrame) -> pd.DataFrame:
        at, who = g["_at"].iloc[0], g["_who"].iloc[0]
        g, t, nxt, first = chain(g)
        n = len(g)
        i = 0 if pd.isna(at) else min(int(np.searchsorted(t, int(at) + ms, "left")), first)
        kept = np.zeros(n, bool)
        while i < n:
            kept[i] = True
            i = int(nxt[i])
        place = np.cumsum(kept) - 1
        rows = np.flatnonzero(kept)
        start = np.full(n, -1) if not len(rows) else np.where(place < 0, -1, rows[np.maximum(place, 0)])
        ids = g[tie].to_numpy()
        g["kept"], g["start_ms"], g["start_id"] = kept, [t[s] if s >= 0 else int(at) for s in start], [ids[s] if s >= 0 else who for s in start]
        return g[[*names, "kept", "start_ms", "start_id"]]

    slim = d.select(*dict.fromkeys([*keys, ts, tie, "_chunk", "_reset"]))
    id_type = df.schema[tie].dataType.simpleString()
    table = slim.groupBy(*keys, "_chunk").applyInPandas(steps, f"{key_ddl}, _chunk long, upto long, end_ms long, end_id {id_type}")
    carry = table.groupBy(*keys).applyInPandas(follow, f"{key_ddl}, _chunk long, _at long, _who {id_type}")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", kept boolean, start_ms long, start_id {id_type}"
    return d.join(carry, [*keys, "_chunk"], "left").groupBy(*keys, "_chunk").applyInPandas(mark, ddl)
