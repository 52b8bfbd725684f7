"""Signals: what a forecast that differs from its reference is worth, and how sure it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import confidence

LEAST_DOLLARS, CONSTRAINED, LEAST_SKILL = 1000.0, 0.5, 0.0


def signals(forecasts: DataFrame) -> DataFrame:
    """Of (station, region, capacity, mw, reference, lo, hi, hours, price, skill, masked): with expected_dollars, confidence,
    label, action and rationale. Null skill watches, as does skill at or under 0."""
    dollars = (F.col("mw") - F.col("reference")) * F.col("hours") * F.col("price")
    sure = confidence(F.coalesce("skill", F.lit(0.0)), F.col("hi") - F.col("lo"), F.col("capacity"), F.col("masked"))
    out = forecasts.withColumn("expected_dollars", dollars).withColumn("confidence", F.coalesce(sure, F.lit(0.0)))
    wide = F.col("hi") - F.col("lo") > F.abs("mw")
    label = F.when(wide, "low").when(F.col("confidence") >= 0.6, "high").when(F.col("confidence") >= 0.3, "medium").otherwise("low")
    action = (
        F.when(F.coalesce("skill", F.lit(0.0)) <= LEAST_SKILL, "watch").when(F.col("reference").between(F.col("lo"), F.col("hi")), "hold")
        .when(F.abs("expected_dollars") < LEAST_DOLLARS, "hold").when(F.col("expected_dollars") > 0, "opportunity").otherwise("risk")
    )
    out = out.withColumn("label", label).withColumn("action", action).withColumn("constrained", F.col("masked") > CONSTRAINED)
    return out.withColumn("rationale", F.format_string("%s: %d MW against %d MW, %s", F.col("action"), F.floor("mw"), F.floor("reference"), F.when(F.col("constrained"), "constrained").otherwise("free")))


def region_signals(found: DataFrame) -> DataFrame:
    """Sums of megawatts and bands, capacity-weighted skill, and whether over half of the capacity is constrained."""
    cap = F.col("capacity")
    return found.groupBy("region").agg(
        *[F.sum(c).alias(c) for c in ("mw", "reference", "lo", "hi", "expected_dollars")],
        F.try_divide(F.sum(F.col("skill") * cap), F.sum(F.when(F.col("skill").isNotNull(), cap))).alias("skill"),
        (F.sum(F.when(F.col("constrained"), cap).otherwise(0.0)) > 0.5 * F.sum(cap)).alias("constrained"),
    )


def fleet_claims(found: DataFrame, prices: DataFrame) -> DataFrame:
    """Per region and horizon of claims (station, region, horizon, capacity, mw, reference, lo, hi, coverage, skill, masked, curve_rmse, n, generated_at,
    constrained, weights map<expert, weight>) at prices (region, rrp): the fleet's claim.

    Megawatts and bands are summed; skill, masked share and the experts' weights are weighted by capacity, as is the error of those that have a
    curve. A claim is as well covered, as much scored and as fresh as its worst member: the least coverage, n and generated_at. It is constrained
    if more than CONSTRAINED of its capacity is. A region without a finite price, or with two, fails.
    """
    cap = F.col("capacity")
    sums = [F.sum(c).alias(c) for c in ("capacity", "mw", "reference", "lo", "hi")]
    least = [F.min(c).alias(c) for c in ("coverage", "n", "generated_at")]
    weighted = [F.try_divide(F.sum(F.col(c) * cap), F.sum(cap)).alias(c) for c in ("skill", "masked")]
    curved = F.try_divide(F.sum(F.col("curve_rmse") * cap), F.sum(F.when(F.col("curve_rmse").isNotNull(), cap)))
    held = F.sum(F.when(F.col("constrained"), cap).otherwise(0.0)) > CONSTRAINED * F.sum(cap)
    fleet = found.groupBy("region", "horizon").agg(F.count("*").alias("stations"), *sums, *least, *weighted, curved.alias("curve_rmse"), held.alias("constrained"))
    each = found.select("region", "horizon", "capacity", F.explode("weights").alias("expert", "w")).groupBy("region", "horizon", "expert").agg(F.sum(F.col("w") * cap).alias("w"))
    mixed = each.groupBy("region", "horizon").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("expert", "w")))).alias("weights"))
    told = prices.groupBy(F.col("region").alias("_r")).agg(F.max("rrp").alias("price"), F.count("*").alias("_n"))
    out = fleet.join(mixed, ["region", "horizon"], "left").join(told, F.col("region") == F.col("_r"), "left")
    bad = F.col("price").isNull() | F.isnan("price") | (F.abs("price") == float("inf")) | (F.col("_n") > 1)
    price = F.when(bad, F.raise_error(F.concat(F.lit("no single price for "), "region")).cast("double")).otherwise(F.col("price"))
    shares = F.transform_values("weights", lambda _, w: w / F.col("capacity"))
    return out.withColumns({"price": price, "weights": shares}).drop("_r", "_n")
