"""Costs by leg, carry and tax; every input is required. Impact is a step function of measured notionals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_impact(orders: DataFrame, steps: DataFrame) -> DataFrame:
    """Add impact_bps: that of the smallest measured notional that is no smaller, NULL beyond the largest. steps: venue, notional, impact_bps (a small table of measurements, checked by its key count)."""
    w = Window.partitionBy("_venue").orderBy("_hi")
    s = steps.select(F.col("venue").alias("_venue"), F.col("notional").alias("_hi"), "impact_bps").withColumn("_lo", F.coalesce(F.lag("_hi").over(w), F.lit(0.0)))
    return orders.join(s, (F.col("venue") == F.col("_venue")) & (F.col("notional") > F.col("_lo")) & (F.col("notional") <= F.col("_hi")), "left").drop("_venue", "_lo", "_hi")


def cost_model(orders: DataFrame) -> DataFrame:
    """Add bps_per_leg and bps_tax (costs, positive is paid), bps_carry (a profit: negative is paid), and refused.

    orders: instrument (spot or perp), fee_bps, order_type (maker or taker), half_spread_bps and impact_bps (a taker's),
    side (+1 or -1), funding_bps_day and days_held (a perp's), tax_bps. Nothing has a default: refused names the
    input that is missing or out of place, and the three figures are then NULL.
    """
    taker, perp = F.col("order_type") == "taker", F.col("instrument") == "perp"
    refused = (
        F.when(F.col("fee_bps").isNull(), "fee")
        .when(~F.coalesce(F.col("instrument").isin("spot", "perp"), F.lit(False)), "instrument")
        .when(~F.coalesce(F.col("order_type").isin("maker", "taker"), F.lit(False)), "order type")
        .when(perp & F.col("funding_bps_day").isNull(), "funding")
        .when(~perp & (F.coalesce("funding_bps_day", F.lit(0.0)) != 0), "funding of spot")
        .when(taker & F.col("half_spread_bps").isNull(), "half-spread")
        .when(taker & F.col("impact_bps").isNull(), "impact")
    )
    o = orders.withColumn("refused", refused)
    fine = F.col("refused").isNull()
    leg = F.col("fee_bps") + F.when(taker, F.col("half_spread_bps") + F.col("impact_bps")).otherwise(0.0)
    carry = F.when(perp, -F.col("side") * F.col("funding_bps_day") * F.col("days_held")).otherwise(0.0)
    return o.withColumns({"bps_per_leg": F.when(fine, leg), "bps_carry": F.when(fine, carry), "bps_tax": F.when(fine, F.coalesce("tax_bps", F.lit(0.0)))})


def weighted_quantiles(df: DataFrame, keys: list[str], x: str, w: str, qs: list[float]) -> DataFrame:
    """Quantiles by midpoints of cumulative weights, linear between, clamped at the ends: one row for each key and q."""
    order = Window.partitionBy(*keys).orderBy(x)
    d = df.groupBy(*keys, x).agg(F.sum(w).alias("_w")).filter("_w > 0")
    d = d.withColumns({"_c": F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w") / 2, "_t": F.sum("_w").over(Window.partitionBy(*keys))}).withColumn("_p", F.col("_c") / F.col("_t"))
    d = d.withColumns({"_np": F.lead("_p").over(order), "_nx": F.lead(x).over(order), "_first": F.row_number().over(order) == 1})
    d = d.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    inside = (F.col("q") >= F.col("_p")) & (F.col("q") < F.col("_np"))
    d = d.filter(inside | (F.col("_first") & (F.col("q") < F.col("_p"))) | (F.col("_np").isNull() & (F.col("q") >= F.col("_p"))))
    value = F.when(inside, F.col(x) + (F.col("_nx") - F.col(x)) * (F.col("q") - F.col("_p")) / (F.col("_np") - F.col("_p"))).otherwise(F.col(x))
    return d.select(*keys, "q", value.alias("value"))


def settled_rates(funding: DataFrame, slot_ms: int, tolerance_ms: int) -> DataFrame:
    """The rate nearest to each settlement slot, within the tolerance."""
    slot = F.round(F.col("ts_ms") / slot_ms).cast("long") * slot_ms
    d = funding.withColumns({"slot": slot, "_away": F.abs(F.col("ts_ms") - slot)}).filter(F.col("_away") <= tolerance_ms)
    return d.groupBy("exchange", "slot").agg(F.min_by("rate", F.struct("_away", "ts_ms")).alias("rate"), F.count("*").alias("n"))
