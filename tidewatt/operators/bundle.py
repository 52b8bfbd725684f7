"""What the weather of a station says of its output: masks, target, correlations, shared information and lag, for all stations at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timeaxis import interpolated, lagged_correlation, peak_lag

STEP = 300
# The longest lag in steps, bins of a variable, the longest gap of the weather in seconds, fuels that the weather drives.
MOST_LAG, BINS, MOST_GAP = 72, 20, 7200
DRIVEN = ("wind", "solar_utility")


def _finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))


def summary(observations: DataFrame) -> DataFrame:
    """Rows (station, n_total, n_used, masked_fraction, capped_fraction, target, start, steps) from (station, at, fuel, output_mw,
    uigf_mw, capped, quality). Used are observations of quality `ok` that are known to be uncapped. The target is UIGF for
    fuels that the weather drives, if half of these have it, else output; null if none is used."""
    used = (F.col("quality") == "ok") & (F.col("capped") == F.lit(False))
    each = observations.groupBy("station").agg(
        F.count("*").alias("n_total"), F.count_if(used).alias("n_used"), F.count_if("capped").alias("_capped"), F.count_if(used & _finite("uigf_mw")).alias("_uigf"),
        F.bool_or(F.col("fuel").isin(*DRIVEN)).alias("_driven"), F.min("at").alias("start"), (F.round((F.max("at") - F.min("at")) / STEP) + 1).cast("int").alias("steps"),
    )
    target = F.when(F.col("n_used") > 0, F.when(F.col("_driven") & (2 * F.col("_uigf") >= F.col("n_used")), "uigf_mw").otherwise("output_mw"))
    return each.select("station", "n_total", "n_used", (1 - F.col("n_used") / F.col("n_total")).alias("masked_fraction"), (F.col("_capped") / F.col("n_total")).alias("capped_fraction"), target.alias("target"), "start", "steps")


def targets(observations: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (station, i, y): the target of the used observations on the station's steps, the last one of a step."""
    used = observations.where((F.col("quality") == "ok") & ~F.col("capped")).join(found.select("station", "target", "start"), "station")
    y = used.select("station", "at", F.round((F.col("at") - F.col("start")) / STEP).cast("int").alias("i"), F.when(F.col("target") == "uigf_mw", F.col("uigf_mw")).otherwise(F.col("output_mw")).alias("y"))
    return y.where(_finite("y")).groupBy("station", "i").agg(F.max_by("y", F.struct("at", "y")).alias("y"))


def shared_bits(pairs: DataFrame, key: str, x: str, y: str, bins: int = BINS) -> DataFrame:
    """Rows (key, bits): mutual information of two columns over equal-width bins; 0 for fewer than 3 pairs or a column that is constant."""
    ends = pairs.groupBy(key).agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for f, n in ((F.min, "lo"), (F.max, "hi"))], F.count("*").alias("_n"))

    def bin_of(c: str) -> Column:
        lo, hi = F.col(f"_lo{c}"), F.col(f"_hi{c}")
        return F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(c) - lo, hi - lo) * bins)), F.lit(0))

    cells = pairs.join(ends, key).groupBy(key, bin_of(x).alias("a"), bin_of(y).alias("b")).agg(F.count("*").alias("n"), F.any_value("_n").alias("_n"))
    both, of_a, of_b = F.col("n"), F.sum("n").over(Window.partitionBy(key, "a")), F.sum("n").over(Window.partitionBy(key, "b"))
    part = cells.select(key, "_n", (both / F.col("_n") * F.log2(both * F.col("_n") / (of_a * of_b))).alias("bits"))
    return part.groupBy(key).agg(F.when(F.max("_n") < 3, 0.0).otherwise(F.sum("bits")).alias("bits"))


def _rank(key: str, column: str) -> Column:
    """Ranks within a key, equal values sharing their mean."""
    same = F.count("*").over(Window.partitionBy(key, column))
    return F.rank().over(Window.partitionBy(key).orderBy(column)) + (same - 1) / 2


def correlated(observations: DataFrame, weather: DataFrame, most: int = MOST_LAG) -> DataFrame:
    """Per station and variable of its weather: the station's summary, target_constant, pearson, spearman, bits, and the peak lag
    in steps with its prominence. Weather is (station, variable, at, value), joined by lines over gaps of up to MOST_GAP.

    A target that never changes, or has no value at all, is constant: its correlations are 0 and tell nothing. Statistics
    of fewer than 3 pairs are 0. Stations without weather have one row with a null variable; variables without a finite value are left out.
    """
    found = summary(observations)
    y = targets(observations, found)
    spread = y.groupBy("station").agg((F.min("y") < F.max("y")).alias("varies"))
    stations = found.join(spread, "station", "left").withColumn("target_constant", F.when(F.col("n_used") > 0, ~F.coalesce("varies", F.lit(False))).otherwise(F.lit(False))).drop("varies")

    samples = weather.where(_finite("value")).select(F.struct("station", "variable").alias("series"), F.col("at").cast("long").alias("at"), "value")
    grid = samples.select("series").distinct().join(found.select(F.col("station").alias("_of"), "start", "steps"), F.col("series.station") == F.col("_of"))
    grid = grid.select("series", F.col("_of").alias("station"), "start", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("i"))
    grid = grid.select("series", (F.col("start") + F.col("i") * STEP).cast("long").alias("at"), "station", "i")
    rows = interpolated(grid, samples, "series", "at", "value", MOST_GAP).withColumnRenamed("value", "x").join(y, ["station", "i"], "left").select("series", "i", "x", "y")
    pairs = rows.where("x is not null and y is not null")

    def pearson(a: str, b: str) -> Column:
        r = F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
        return F.when(F.count("*") < 3, 0.0).otherwise(F.coalesce(r, F.lit(0.0)))

    ranked = pairs.withColumns({"rx": _rank("series", "x"), "ry": _rank("series", "y")})
    told = ranked.groupBy("series").agg(F.count("*").alias("n_pairs"), pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"))
    lag = peak_lag(lagged_correlation(rows, "series", "i", "x", "y", most), "series", most).select("series", F.col("lag").alias("peak_lag"), "prominence")
    out = grid.select("series").distinct().join(told, "series", "left").join(shared_bits(pairs, "series", "x", "y"), "series", "left").join(lag, "series", "left")
    out = out.select("series.*", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pearson", "spearman", "bits")], "peak_lag", "prominence")
    return stations.drop("start", "steps").join(out, "station", "left")
