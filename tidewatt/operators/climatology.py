"""Mean output by station, month and time of day, learned in order with a floor under the learning rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import affine_prefix, rank_in_group

BUCKET_MINUTES = 30
#: A cell's newest reading counts for this share at least, so that a cell with many readings still moves.
LEAST_RATE = 1 / 500


def cells(readings: DataFrame, bucket_minutes: int = BUCKET_MINUTES, least_rate: float = LEAST_RATE) -> DataFrame:
    """Of readings (station, at in seconds, value): station, month, bucket, mean, n for each cell, and with a null month for each
    time of day whatever the month.

    A cell's n-th reading in order of time (then value) moves its mean by max(1/n, least_rate) of the way. Null and non-finite values
    are left out. Each cell is a recurrence over its readings that is split over tasks.
    """
    good = readings.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    at = F.timestamp_seconds("at")
    bucket = F.floor((F.hour(at) * 60 + F.minute(at)) / bucket_minutes)
    rows = good.select("station", F.explode(F.array(F.month(at), F.lit(None))).alias("month"), bucket.alias("bucket"), "at", F.col("value").cast("double").alias("value"))
    cell = F.to_json(F.struct("station", "month", "bucket"))
    order = [F.col("at").asc(), F.col("value").asc()]
    ranked = rank_in_group(rows, cell, order, "n")
    rate = F.greatest(1 / F.col("n"), F.lit(least_rate))
    means = affine_prefix(ranked, cell, [F.col("n").asc()], 1 - rate, rate * F.col("value"), "mean")
    return means.groupBy("station", "month", "bucket").agg(F.max_by("mean", "n").alias("mean"), F.max("n").alias("n"))


def expected(targets: DataFrame, known: DataFrame, bucket_minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Targets (station, at, last, capacity) with `expected`: the mean of their cell, else of their time of day whatever the month, else
    the station's `last` reading; between 0 and capacity."""
    at = F.timestamp_seconds("at")
    keyed = targets.withColumns({"_month": F.month(at), "_bucket": F.floor((F.hour(at) * 60 + F.minute(at)) / bucket_minutes)})
    own = known.where("month is not null").select(F.col("station").alias("_s1"), F.col("month").alias("_m1"), F.col("bucket").alias("_b1"), F.col("mean").alias("_own"))
    any_ = known.where("month is null").select(F.col("station").alias("_s2"), F.col("bucket").alias("_b2"), F.col("mean").alias("_any"))
    out = keyed.join(own, (F.col("station") == F.col("_s1")) & (F.col("_month") == F.col("_m1")) & (F.col("_bucket") == F.col("_b1")), "left")
    out = out.join(any_, (F.col("station") == F.col("_s2")) & (F.col("_bucket") == F.col("_b2")), "left")
    value = F.coalesce("_own", "_any", "last")
    return out.select(*targets.columns, F.greatest(F.lit(0.0), F.least(value, F.col("capacity"))).alias("expected"))
