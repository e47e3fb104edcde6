"""As-of joins by one union, one sort and one window: linear in both inputs, whatever the rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str, *, forward: bool = False, strict: bool = False, tolerance: int | None = None, chunk: int = 86_400_000, ties: tuple[str, ...] = ()) -> DataFrame:
    """left with the columns of the nearest right row before it (or after it), or NULLs.

    keys name equal columns on both sides; strict leaves out a right row of the same instant; tolerance
    bounds the distance, chunk is the span of time that is sorted together. right's other columns must not be in left. Rows of right with the same key and
    instant: the last (first, if forward) by ties is taken, then by the columns. ties name columns of right that are not returned.
    """
    extra = [c for c in right.columns if c not in (*keys, *ties)]
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ts).alias("_at"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*extra)).schema[0].dataType).alias("_right"), *[F.lit(None).cast(right.schema[t].dataType).alias(f"_t{i}") for i, t in enumerate(ties)])
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_ts).alias("_at"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), F.struct(*extra).alias("_right"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    # Backward and inclusive, right rows of the same instant come first; strict turns this round, and so does forward.
    if not forward:
        side_of = {"left": 0 if strict else 1, "right": 1 if strict else 0}
    else:
        side_of = {"left": 1 if strict else 0, "right": 0 if strict else 1}
    a, b = a.withColumn("_side", F.lit(side_of["left"])), b.withColumn("_side", F.lit(side_of["right"]))
    own = [f"_k{i}" for i in range(len(keys))]
    both = a.unionByName(b).withColumn("_chunk", F.floor(F.col("_at") / chunk))
    # Forward is backward over the reversed order: a frame up to the end would be built anew for every row, in squared time.
    turn = F.desc if forward else F.asc
    order = ["_at", "_side", *[f"_t{i}" for i in range(len(ties))], "_right"]
    frame = Window.partitionBy(*own, "_chunk").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, 0)
    near = F.struct(*[c for c in order if c != "_side"])
    edge = (F.min_by if forward else F.max_by)("_right", F.when(F.col("_right").isNotNull(), near))
    across = Window.partitionBy(*own).orderBy(turn("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    edges = both.groupBy(*own, "_chunk").agg(edge.alias("_edge")).select(*own, "_chunk", F.last("_edge", ignorenulls=True).over(across).alias("_edge"))
    out = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(frame)).filter(F.col("_left").isNotNull())
    out = out.join(edges, [*own, "_chunk"], "left").withColumn("_hit", F.coalesce("_hit", "_edge"))
    if tolerance is not None:
        far = F.abs(F.col("_at") - F.col(f"_hit.{right_ts}")) > tolerance
        out = out.withColumn("_hit", F.when(~far, F.col("_hit")))
    return out.select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in extra])
