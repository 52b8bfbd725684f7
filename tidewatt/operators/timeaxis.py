"""As-of joins, interpolation and lagged correlation without range joins.

Each is a union of both sides and one sort within the key, or an equi join on an offset key;
a key's rows are never paired with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _both(grid: DataFrame, samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    left = grid.select(key, at, *[c for c in grid.columns if c not in (key, at)], F.lit(True).alias("_grid"), F.lit(None).cast("double").alias("_v"))
    right = samples.select(key, at, F.lit(False).alias("_grid"), F.col(value).cast("double").alias("_v"))
    return left.unionByName(right, allowMissingColumns=True)


def as_of(grid: DataFrame, samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Grid rows with the newest sample at or before them (null where there is none); `at` must order samples of a key."""
    w = Window.partitionBy(key).orderBy(at, "_grid").rowsBetween(Window.unboundedPreceding, 0)
    out = _both(grid, samples, key, at, value).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return out.where("_grid").drop("_grid", "_v")


def interpolated(grid: DataFrame, samples: DataFrame, key: str, at: str, value: str, max_gap: float | None = None, hold: bool = False) -> DataFrame:
    """Grid rows with the line between the samples around them; exact on a sample. Outside, or in a gap over `max_gap`,
    null; with `hold` the last sample goes on. `at` is a number. Equal times of a key must be one sample."""
    both = _both(grid, samples, key, at, value).withColumn("_t", F.when(~F.col("_grid"), F.col(at)))
    back = Window.partitionBy(key).orderBy(at, "_grid").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(at, F.col("_grid").desc()).rowsBetween(0, Window.unboundedFollowing)
    for name, source, w, pick in (("_v0", "_v", back, F.last), ("_t0", "_t", back, F.last), ("_v1", "_v", ahead, F.first), ("_t1", "_t", ahead, F.first)):
        both = both.withColumn(name, pick(source, ignorenulls=True).over(w))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.try_divide((F.col(at) - F.col("_t0")).cast("double"), (F.col("_t1") - F.col("_t0")).cast("double"))
    inside = F.lit(True) if max_gap is None else (F.col("_t1") - F.col("_t0") <= max_gap)
    exact = F.col("_t0") == F.col(at)
    out = F.when(exact, F.col("_v0")).when(F.col("_t1").isNotNull() & inside, line)
    out = out.when(F.col("_t1").isNull(), F.col("_v0")) if hold else out
    return both.withColumn(value, out).where("_grid").drop("_grid", "_v", "_t", "_v0", "_t0", "_v1", "_t1")


def monotone_cubic(grid: DataFrame, samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Grid rows on the monotone cubic through the samples: harmonic slopes inside, limited three-point slopes at the ends.

    The ends are held outside the samples, one sample holds everywhere, a key without samples gives null. `at` is a
    number; samples of a key at the same time fail. No sample's value is overshot.
    """
    w = Window.partitionBy(key).orderBy(at)
    s = samples.where(F.col(value).isNotNull()).select(key, F.col(at).cast("double").alias(at), F.col(value).cast("double").alias("_y"))
    s = s.withColumn("_h", F.lead(at).over(w) - F.col(at)).withColumn("_d", (F.lead("_y").over(w) - F.col("_y")) / F.nullif("_h", F.lit(0.0)))
    s = s.withColumn("_h", F.when(F.col("_h") <= 0, F.raise_error(F.lit("two samples of a key at one time"))).otherwise(F.col("_h")))
    h0, d0, h1, d1 = F.lag("_h").over(w), F.lag("_d").over(w), F.col("_h"), F.col("_d")
    harmonic = 3 * (h0 + h1) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1)
    inner = F.when(d0 * d1 <= 0, 0.0).otherwise(harmonic)
    first = _end_slope(h1, d1, F.lead("_h").over(w), F.lead("_d").over(w))
    final = _end_slope(h0, d0, F.lag("_h", 2).over(w), F.lag("_d", 2).over(w))
    s = s.withColumn("_m", F.when(h0.isNull(), first).when(h1.isNull(), final).otherwise(inner))
    knots = s.select(key, F.col(at), F.lit(False).alias("_grid"), F.struct(F.col(at).alias("t"), "_y", "_m").alias("_k"))
    both = grid.withColumn("_grid", F.lit(True)).withColumn("_k", F.lit(None).cast(knots.schema["_k"].dataType)).unionByName(knots, allowMissingColumns=True)
    back = Window.partitionBy(key).orderBy(at, "_grid").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(at, F.col("_grid").desc()).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_a", F.last("_k", ignorenulls=True).over(back)).withColumn("_b", F.first("_k", ignorenulls=True).over(ahead))
    a, b, width = F.col("_a"), F.col("_b"), F.col("_b.t") - F.col("_a.t")
    x = F.try_divide(F.col(at) - a["t"], width)
    rise = b["_y"] - a["_y"]
    bend = x * (1 - x) * ((1 - x) * (width * a["_m"] - rise) - x * (width * b["_m"] - rise))
    inside = F.when(width == 0, a["_y"]).otherwise(a["_y"] + x * rise + bend)
    return both.withColumn(value, F.coalesce(inside, a["_y"], b["_y"])).where("_grid").select(*dict.fromkeys([*grid.columns, value]))


def _end_slope(near: Column, d_near: Column, far: Column, d_far: Column) -> Column:
    """Slope at an end, of the two secants next to it; of the one where there is one."""
    m = ((2 * near + far) * d_near - near * d_far) / (near + far)
    limited = F.when(m * d_near <= 0, 0.0).when((d_near * d_far < 0) & (F.abs(m) > 3 * F.abs(d_near)), 3 * d_near).otherwise(m)
    return F.when(d_far.isNull(), d_near).otherwise(limited)


def peak_lag(correlations: DataFrame, key: str, most: int, prominence: float = 1e-4) -> DataFrame:
    """Of (key, lag, r) the lag of greatest |r|, the first of equals; null if it is at an edge or hardly stands out."""
    strength = F.abs("r")
    found = correlations.groupBy(key).agg(F.min(F.struct((-strength).alias("s"), "lag")).alias("top"), (F.max(strength) - F.min(strength)).alias("prominence"), F.max(strength).alias("strength"))
    lag = F.when((F.col("prominence") >= prominence) & (F.abs(F.col("top.lag")) < most), F.col("top.lag"))
    return found.select(key, lag.alias("lag"), "prominence", "strength")


def lagged_correlation(rows: DataFrame, key: str, step: str, x: str, y: str, most: int) -> DataFrame:
    """Pearson correlation of x[i] with y[i + lag] for lags up to `most` either way: (key, lag, n, r), 0 where it is undefined.
    A null x or y has no pairs."""
    shifted = rows.where(F.col(x).isNotNull()).select(key, F.col(step), F.col(x).alias("_x"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    shifted = shifted.withColumn("_at", F.col(step) + F.col("lag")).drop(step)
    pairs = shifted.join(rows.where(F.col(y).isNotNull()).select(key, F.col(step).alias("_at"), F.col(y).alias("_y")), [key, "_at"])
    r = F.try_divide(F.covar_pop("_x", "_y"), F.nullif(F.stddev_pop("_x") * F.stddev_pop("_y"), F.lit(0.0)))
    return pairs.groupBy(key, "lag").agg(F.count("*").alias("n"), F.when(F.count("*") < 3, 0.0).otherwise(F.coalesce(r, F.lit(0.0))).alias("r"))
