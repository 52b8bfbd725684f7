"""Folds of a whole window of dispatch rows, where a missing value counts as nothing produced.

Unlike the folds of `observations`, these take one instant for all fields. Rows are (at, unit, intervention, mw, cleared,
availability, uigf, capped), `at` in seconds at the end of the interval; units are (unit, station, dispatch_type), stations
(station, capacity). One aggregate by station and instant is joined to one by station.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .observations import MOST_OF_CAPACITY

STEP = 300


def _over(mw: Column, capacity: Column) -> Column:
    """Output beyond what a capacity allows; never of a capacity that is null, not finite, zero or less."""
    known = capacity.isNotNull() & ~F.isnan(capacity) & (capacity != float("inf")) & (capacity > 0)
    return F.coalesce(known & (mw > MOST_OF_CAPACITY * capacity), F.lit(False))


def _folded(rows: DataFrame, stations: DataFrame) -> DataFrame:
    """One row a station and instant, with a quality: `suspect`, else `partial` if fewer units have a row than in the window, else `ok`."""
    sums = {name: F.sum(F.coalesce(F.col(of), F.lit(0.0))).alias(name) for name, of in (("output_mw", "mw"), ("cleared_mw", "cleared"), ("available_mw", "availability"))}
    each = rows.groupBy("station", "at").agg(
        *sums.values(), F.sum("uigf").alias("uigf_mw"), F.coalesce(F.bool_or("capped"), F.lit(False)).alias("capped"),
        F.count_if(F.coalesce(F.col("mw") > 0, F.lit(False))).alias("online"), F.count_distinct("unit").alias("units"),
    )
    window = rows.groupBy("station").agg(F.count_distinct("unit").alias("expected"))
    held = each.join(window, "station").join(stations.select("station", F.col("capacity").cast("double").alias("capacity")), "station", "left")
    quality = F.when(_over(F.col("output_mw"), F.col("capacity")), "suspect").when(F.col("units") < F.col("expected"), "partial").otherwise("ok")
    return held.withColumn("quality", quality).withColumn("at", F.col("at") - STEP).drop("capacity", "expected")


def day_fold(rows: DataFrame, units: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows (station, at, output_mw, cleared_mw, available_mw, uigf_mw, curtailed_mw, capped, online, units, quality) of a day.

    Rows of an intervention are left out, since they repeat an interval. A unit is online if it produces. Only a capped
    station curtails: what its UIGF, null if no unit has one, is over its output. Unknown units drop out.
    """
    base = rows.where(F.coalesce(F.col("intervention") != 1, F.lit(True))).join(units.select("unit", "station"), "unit")
    spilt = F.when(F.col("capped") & F.col("uigf_mw").isNotNull(), F.greatest(F.lit(0.0), F.col("uigf_mw") - F.col("output_mw"))).otherwise(0.0)
    return _folded(base, stations).withColumn("curtailed_mw", spilt)


def sweep_fold(rows: DataFrame, units: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows (station, at, output_mw, cleared_mw, uigf_mw, capped, quality) for a backtest: loads are left out, and a station is whole
    if all its units that have a row anywhere in the window have one at the instant."""
    makers = units.where(~F.col("dispatch_type").eqNullSafe("LOAD")).select("unit", "station")
    return _folded(rows.join(makers, "unit"), stations).select("station", "at", "output_mw", "cleared_mw", "uigf_mw", "capped", "quality")


def unmasked(readings: DataFrame, stations: DataFrame, admit: bool = False) -> DataFrame:
    """Observations from readings (station, at, mw, quality, facilities) of stations whose market tells of no caps.

    `capped` is null, or false where `admit` lets such readings pass for uncapped ones. Fields that aren't told are null,
    a missing quality is `ok`, missing facilities are none. Stations that aren't known drop out.
    """
    none = F.lit(None).cast("double")
    return readings.join(stations.select("station", "capacity"), "station").select(
        "station", "capacity", (F.col("at") - STEP).alias("at"), F.col("mw").alias("output_mw"), none.alias("uigf_mw"), none.alias("cleared_mw"), none.alias("available_mw"), F.lit(0.0).alias("curtailed_mw"),
        F.lit(False if admit else None).cast("boolean").alias("capped"), F.coalesce("quality", F.lit("ok")).alias("quality"), F.coalesce(F.col("facilities").cast("long"), F.lit(0)).alias("online"),
    )
