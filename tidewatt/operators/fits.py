"""Fitted response curves from sums that Spark adds up: wind by damped Gauss-Newton steps, panels in closed form."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

LEAST_POINTS, STEPS, DELTA, TOLERANCE = 100, 60, 0.08, 1e-8
#: Where the search begins, and the bounds of low, high, slope and middle.
STARTS = ((0.0, 0.95, 0.6, 9.0), (0.02, 0.8, 1.2, 6.0), (0.02, 0.8, 0.4, 12.0))
LOWER, UPPER = (0.0, 0.0, 0.05, 2.0), (1.2, 1.2, 10.0, 20.0)
_P = ["p0", "p1", "p2", "p3"]
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_SUMS = ["n", "loss", "squares", *(f"a{i}{j}" for i, j in _PAIRS), *(f"g{i}" for i in range(4))]
_STATE = "key long, start int, " + ", ".join(f"{c} double" for c in [*_P, "damping", "moved", *(f"b{c}" for c in [*_P, *_SUMS])])


def logistic(p: list[Column], speed: Column) -> Column:
    return p[0] + (p[1] - p[0]) / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), p[2] * (speed - p[3])))))


def _sums(readings: DataFrame, state: DataFrame) -> DataFrame:
    """One aggregate over all readings: for each key and start the Huber loss at its trial, and the normal equations there, weighted
    as the loss weighs each residual. Sums are formed in the map tasks, so a key with any part of all rows is no burden."""
    rows = readings.join(state.select("key", "start", *_P), "key")
    s = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("p2") * (F.col("speed") - F.col("p3"))))))
    rows = rows.select("key", "start", (F.col("p0") + (F.col("p1") - F.col("p0")) * s - F.col("share")).alias("r"), s.alias("s"), "p0", "p1", "p2", "p3", "speed")
    steep = (F.col("p1") - F.col("p0")) * F.col("s") * (1 - F.col("s"))
    slopes = [1 - F.col("s"), F.col("s"), steep * (F.col("speed") - F.col("p3")), -steep * F.col("p2")]
    far = F.abs("r") > DELTA
    rows = rows.select("key", "start", "r", F.when(far, DELTA / F.abs("r")).otherwise(1.0).alias("w"), F.when(far, DELTA * (F.abs("r") - DELTA / 2)).otherwise(F.col("r") * F.col("r") / 2).alias("l"), *(d.alias(f"d{i}") for i, d in enumerate(slopes)))
    w = F.col("w")
    each = [F.count("*").cast("double").alias("n"), F.sum("l").alias("loss"), F.sum(F.col("r") * F.col("r")).alias("squares")]
    each += [F.sum(w * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"a{i}{j}") for i, j in _PAIRS] + [F.sum(w * F.col(f"d{i}") * F.col("r")).alias(f"g{i}") for i in range(4)]
    return rows.groupBy("key", "start").agg(*each)


def _next(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a key and start: a trial that is better than the best is taken, and the next one solved for from the best one's equations."""
    for f in frames:
        better = ~(f["loss"] >= f["bloss"]).to_numpy()
        level = better & (f["bloss"] - f["loss"] <= 1e-12 * f["loss"] + 1e-18 * f["n"]).to_numpy() & (f["damping"] < 1).to_numpy()
        for c in [*_P, *_SUMS]:
            f[f"b{c}"] = np.where(better, f[c], f[f"b{c}"])
        f["damping"] = np.where(better, f["damping"] / 5, f["damping"] * 4).clip(1e-12, 1e12)
        a, g, at = np.zeros((len(f), 4, 4)), f[[f"bg{i}" for i in range(4)]].to_numpy(), f[[f"b{c}" for c in _P]].to_numpy()
        for i, j in _PAIRS:
            a[:, i, j] = a[:, j, i] = f[f"ba{i}{j}"]
        lower, upper = np.array(LOWER), np.array(UPPER)
        held = ((at <= lower) & (g > 0)) | ((at >= upper) & (g < 0))  # at a bound and pushed against it
        free = ~held
        a *= free[:, :, None] * free[:, None, :]
        diagonal = np.einsum("kii->ki", a)
        diagonal += diagonal * f["damping"].to_numpy()[:, None] + 1e-12 + held
        trial = np.clip(at - np.linalg.solve(a, (g * free)[:, :, None])[:, :, 0], lower, upper)
        f["moved"] = np.where(level, 0.0, np.abs(trial - at).max(axis=1))
        f[_P] = trial
        yield f[[c.split(" ")[0] for c in _STATE.split(", ")]]


def fit_wind(readings: DataFrame) -> DataFrame:
    """Of readings (key, speed, share): low, high, slope and middle of the logistic of least Huber loss for each key with at least
    LEAST_POINTS complete rows, with rmse, n and whether the search came to rest.

    All keys are fitted together: each of at most STEPS steps is one aggregate over the readings, from which damped Gauss-Newton
    steps of bounded parameters follow, a small one for each key and start. Steps are written to the shared folder.
    """
    spark, folder = readings.sparkSession, f"{shared_folder(readings.sparkSession)}/wind-{uuid.uuid4().hex}"
    rows = readings.select("key", F.col("speed").cast("double").alias("speed"), F.col("share").cast("double").alias("share")).dropna()
    rows = rows.where(~F.isnan("speed") & ~F.isnan("share"))
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    keys = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") >= LEAST_POINTS)
    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), *(F.lit(v).alias(c) for c, v in zip(_P, s, strict=True))) for i, s in enumerate(STARTS)]))
    names = [c.split(" ")[0] for c in _STATE.split(", ")]
    state = keys.select("key", starts.alias("s")).select("key", "s.*").withColumns({"damping": F.lit(5e-3), "moved": F.lit(1.0)} | {f"b{c}": F.lit(float("inf") if c == "loss" else 0.0) for c in [*_P, *_SUMS]})
    state.select(names).write.parquet(f"{folder}/0")
    for step in range(1, STEPS + 1):
        state = spark.read.parquet(f"{folder}/{step - 1}")
        going = state.where((F.col("moved") > TOLERANCE) & (F.col("damping") < 1e12))
        rest = state.where(~((F.col("moved") > TOLERANCE) & (F.col("damping") < 1e12)))
        moved = going.join(_sums(rows, going), ["key", "start"]).mapInPandas(_next, _STATE)
        moved.union(rest.select(names)).write.parquet(f"{folder}/{step}")
        if spark.read.parquet(f"{folder}/{step}").where((F.col("moved") > TOLERANCE) & (F.col("damping") < 1e12)).isEmpty():
            break
    best = spark.read.parquet(f"{folder}/{step}").withColumn("rest", (F.col("moved") <= TOLERANCE) | (F.col("damping") >= 1e12))
    best = best.groupBy("key").agg(F.min_by(F.struct(*(f"b{c}" for c in _P), "bsquares", "bn", "rest"), F.struct("bloss", "start")).alias("f"))
    return best.select("key", *(F.col(f"f.b{c}").alias(n) for c, n in zip(_P, ("low", "high", "slope", "middle"), strict=True)), F.sqrt(F.col("f.bsquares") / F.col("f.bn")).alias("rmse"), F.col("f.bn").cast("long").alias("n"), F.col("f.rest").alias("converged"))


def with_curves(stations: DataFrame, fits: DataFrame, grid: list[float]) -> DataFrame:
    """Stations (key) with `curve`, their fitted share at the speeds of a grid, where their fit came to rest; null for others."""
    f = fits.where("converged").select(F.col("key").alias("_key"), *("low", "high", "slope", "middle"))
    curve = F.transform(F.array(*map(F.lit, grid)), lambda x: logistic([F.col(c) for c in ("low", "high", "slope", "middle")], x))
    return stations.join(f, F.col("key") == F.col("_key"), "left").select(*stations.columns, F.when(F.col("_key").isNotNull(), curve).alias("curve"))


def fit_solar(readings: DataFrame) -> DataFrame:
    """Of readings (key, ghi, excess, share): gain and loss of share = gain * ghi - loss * ghi * excess, by least squares
    from sums alone; where these can't tell the two apart, gain only. Rows with a null are left out."""
    a, b, y = F.col("ghi") / 1000, F.col("ghi") / 1000 * F.col("excess"), F.col("share")
    sums = readings.dropna().groupBy("key").agg(F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"), F.sum(a * y).alias("ay"), F.sum(b * y).alias("by_"), F.count("*").alias("n"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    full = det > 1e-12 * F.col("aa") * F.col("bb")
    gain = F.when(full, F.try_divide(F.col("ay") * F.col("bb") - F.col("by_") * F.col("ab"), det)).otherwise(F.try_divide("ay", "aa"))
    loss = F.when(full, -F.try_divide(F.col("by_") * F.col("aa") - F.col("ay") * F.col("ab"), det)).otherwise(0.0)
    return sums.select("key", gain.alias("gain"), loss.alias("loss"), "n")
