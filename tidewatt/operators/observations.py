"""Observations of stations from dispatch rows: folds, quality, ramps, prices, and guards that refuse bad input.

Frames in, frames out. Unit rows are `at` (timestamp, end of the interval), `unit` and values; units have
(unit, station, dispatch_type, schedule_type), stations (station, capacity, battery). All folds are one
aggregate by station and instant, which is combined in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: An online unit gives or takes more than so many MW.
ONLINE_MW = 1.0
#: Output of more than so many times the capacity is suspect.
MOST_OF_CAPACITY = 1.15
PRICE_CAP, PRICE_FLOOR = 23_200.0, -1_000.0


def _interval() -> Column:
    return F.expr("interval 5 minutes")


def to_mw(value: Column, unit: Column, minutes: int = 5) -> Column:
    """MW from a value in MW, or in MWh over `minutes`; null stays null, any other unit is refused."""
    known = F.when(unit == "MW", value).when(unit == "MWh", value * 60 / minutes)
    return F.when(value.isNotNull(), known.otherwise(F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("none"))))))


def shifted(at: Column, field: Column, minutes: dict[str, int]) -> Column:
    """The instant a field speaks of: `at` moved by the field's minutes, whatever the case; an unknown field is refused."""
    out = F.lit(None).cast("long")
    for name, by in minutes.items():
        out = F.when(F.upper(field) == name.upper(), F.lit(by)).otherwise(out)
    moved = F.when(out.isNull(), F.raise_error(F.concat(F.lit("unknown field: "), F.coalesce(field, F.lit("none")))).cast("long")).otherwise(out)
    return F.timestamp_seconds(F.unix_timestamp(at) + moved * 60)


def finite(value: Column, what: str) -> Column:
    """A finite value, or an error that says what is not."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{what} is not finite")).cast("double")).otherwise(value)


def finite_or(value: Column, fallback: float) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(fallback)).otherwise(value)


def percent_of_capacity(error: Column, capacity: Column) -> Column:
    """100 times error over capacity; a capacity that is null, not finite, zero or less is refused."""
    bad = capacity.isNull() | F.isnan(capacity) | (F.abs(capacity) == float("inf")) | (capacity <= 0)
    return F.when(bad, F.raise_error(F.lit("capacity must be positive")).cast("double")).otherwise(100 * error / capacity)


def strict_instant(text: Column) -> Column:
    """A timestamp from ISO text that states its offset; text without one is refused, null stays null."""
    stated = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    whole = F.regexp_replace(text, r"^(.{16})(Z|[+-])", "$1:00$2")  # seconds may be left out
    return F.when(text.isNull(), F.lit(None)).when(stated, F.to_timestamp(whole)).otherwise(F.raise_error(F.concat(F.lit("no offset in "), text)).cast("timestamp"))


def binding(rows: DataFrame, keys: list[str], run: str, first: list[str]) -> DataFrame:
    """Of the rows of each key that with the highest run; of equal runs the first by the columns `first`."""
    order = F.struct(F.col(run).alias("_run"), *[F.negative(F.col(c)).alias(f"_{c}") for c in first])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("best"))
    return best.select("best.*")


def prices(rows: DataFrame, price: str = "rrp") -> DataFrame:
    """`rows` with `out_of_band` for a price above the cap or below the floor; the price is left as it is, null is refused."""
    value = F.when(F.col(price).isNull(), F.raise_error(F.lit("a price is missing")).cast("double")).otherwise(F.col(price))
    return rows.withColumn(price, value).withColumn("out_of_band", (F.col(price) > PRICE_CAP) | (F.col(price) < PRICE_FLOOR))


def settlement_price(rows: DataFrame, keys: list[str], run: str = "run", price: str = "rrp") -> DataFrame:
    """A price for each key: of run 0 if there is one, else of run 1; two prices in the chosen run are refused."""
    least = rows.groupBy(*keys, run).agg(F.min(price).alias("lo"), F.max(price).alias("hi"))
    chosen = least.groupBy(*keys).agg(F.min_by(F.struct("lo", "hi"), run).alias("p"))
    price_of = F.when(F.col("p.lo").eqNullSafe(F.col("p.hi")), F.col("p.lo")).otherwise(F.raise_error(F.lit("ambiguous settlement price")).cast("double"))
    return chosen.select(*keys, price_of.alias(price))


def _signed(mw: str) -> Column:
    return F.when(F.col("dispatch_type") == "LOAD", -F.col(mw)).otherwise(F.col(mw))


def output_fold(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (station, at, output_mw, online, units) from metered unit rows (at, unit, mw). The meter reads at the start of the
    interval, so `at` moves back by it. Loads count negative; the sum of nulls alone is null. Unknown units drop out."""
    joined = rows.join(units, "unit").withColumn("mw", _signed("mw"))
    return joined.groupBy("station", (F.col("at") - _interval()).alias("at")).agg(
        F.sum("mw").alias("output_mw"), F.count_if(F.abs("mw") > ONLINE_MW).alias("online"), F.count_distinct(F.when(F.col("mw").isNotNull(), F.col("unit"))).alias("units")
    )


def solution_fold(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (station, at, availability_mw, uigf_mw, cleared_semi_mw, curtailed_mw, capped) from a dispatch solution (at, unit,
    availability, uigf, cleared, capped). These hold at the end of the interval. Availability leaves loads out; UIGF
    and cleared count semi-scheduled units alone; one capped unit caps the station. Curtailed is what UIGF has over
    cleared, at least 0, and null without UIGF."""
    joined = rows.join(units, "unit")
    semi = F.col("schedule_type") == "SEMI-SCHEDULED"
    out = joined.groupBy("station", "at").agg(
        F.sum(F.when(F.col("dispatch_type") != "LOAD", F.col("availability"))).alias("availability_mw"),
        F.sum(F.when(semi, F.col("uigf"))).alias("uigf_mw"), F.sum(F.when(semi, F.col("cleared"))).alias("cleared_semi_mw"), F.bool_or("capped").alias("capped"),
    )
    return out.withColumn("curtailed_mw", F.when(F.col("uigf_mw").isNotNull(), F.greatest(F.lit(0.0), F.col("uigf_mw") - F.coalesce("cleared_semi_mw", F.lit(0.0)))))


def expected_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """(station, expected): the distinct units that report a value anywhere in the rows."""
    return rows.where("mw is not null").join(units, "unit").groupBy("station").agg(F.count_distinct("unit").alias("expected"))


def assemble(output: DataFrame, solution: DataFrame, expected: DataFrame, stations: DataFrame, ambiguous: DataFrame | None = None) -> DataFrame:
    """Observations in the order of time and station: both folds joined at their instants, with a quality.

    `suspect`: a station whose sign is ambiguous, output over MOST_OF_CAPACITY of the capacity, or a ramp from the
    row exactly one interval before of more than the capacity (twice that for a battery). Else `partial` where
    fewer units report than expected, else `ok`. Null outputs are neither over nor ramps.
    """
    both = output.join(solution, ["station", "at"], "full").join(expected, "station", "left").join(stations, "station")
    signs = both.withColumn("ambiguous", F.lit(False)) if ambiguous is None else both.join(ambiguous.select("station", F.lit(True).alias("ambiguous")).distinct(), "station", "left")
    before = Window.partitionBy("station").orderBy("at")
    reach = F.when(F.col("battery"), 2 * F.col("capacity")).otherwise(F.col("capacity"))
    next_to = F.lag("at").over(before) == F.col("at") - _interval()
    ramp = next_to & (F.abs(F.col("output_mw") - F.lag("output_mw").over(before)) > reach)
    suspect = F.coalesce("ambiguous", F.lit(False)) | F.coalesce(F.abs("output_mw") > MOST_OF_CAPACITY * F.col("capacity"), F.lit(False)) | F.coalesce(ramp, F.lit(False))
    short = F.coalesce(F.col("output_mw").isNotNull() & (F.col("units") < F.col("expected")), F.lit(False))
    quality = F.when(suspect, "suspect").when(short, "partial").otherwise("ok")
    return signs.withColumn("quality", quality).drop("ambiguous").orderBy("at", "station")


def unknown_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """One row (n_units, total_mw): what units that are not registered produce, those over 0.5 MW."""
    return rows.join(units, "unit", "left_anti").where(F.abs("mw") > 0.5).agg(F.count_distinct("unit").alias("n_units"), F.coalesce(F.sum(F.abs("mw")), F.lit(0.0)).alias("total_mw"))
