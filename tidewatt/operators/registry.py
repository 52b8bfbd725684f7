"""The station registry: units of today, placed by a cascade of keys, with their main fuel, and which are modelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normal_name, without_unit_number

# Words that a station's name goes without, shares of the modelled fleet, codes of storage units.
NAME_WORDS = ["NETT? *OFF", "POWER STATION", "WIND FARM", "SOLAR FARM", "GAS TURBINE", "COGENERATION", "PLANT", "POWER", "STATION", "FARM"]
QUOTAS = {"wind": 0.45, "solar": 0.30, "thermal": 0.15, "hydro": 0.05, "west": 0.05}
STORAGE = r"^(BESS|ESR)\d*$"


def in_force(registrations: DataFrame, now: Column) -> DataFrame:
    """One row a unit: the newest begun and not ended by `now`, else the newest of all. A row without a start is not in force."""
    live = F.coalesce((F.col("start") <= now) & (F.col("end").isNull() | (F.col("end") > now)), F.lit(False))
    order = Window.partitionBy("unit").orderBy(live.desc(), F.col("start").desc_nulls_last(), F.col("station").asc_nulls_last())
    return registrations.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def main_fuel(facilities: DataFrame) -> DataFrame:
    """(code, fuel) of facilities with units array<struct<fuel, capacity>>: the fuel with most capacity, the first by name of equals."""
    units = facilities.select("code", F.explode("units").alias("u")).where("u.fuel is not null")
    sums = units.groupBy("code", F.col("u.fuel").alias("fuel")).agg(F.sum(F.coalesce("u.capacity", F.lit(0.0))).alias("mw"))
    return sums.groupBy("code").agg(F.min(F.struct((-F.col("mw")).alias("mw"), "fuel"))["fuel"].alias("fuel"))


def placed(units: DataFrame, names: DataFrame, facilities: DataFrame) -> DataFrame:
    """Stations of `units` (unit, station, region, dispatch, schedule) with the facility that the first key finds.

    Keys, in order: the station's code, its normal name, a unit's code, a unit's code without its number. All are one
    equi join on (kind, key); the least (priority, unit) wins. Stations that none finds are kept without a place.
    """
    named = units.where("station is not null").join(names.select("station", "name").dropDuplicates(["station"]), "station", "left")
    named = named.withColumn("name", F.coalesce("name", "station"))
    stations = named.groupBy("station").agg(
        F.min("name").alias("name"), F.min("region").alias("region"), F.count_if(F.coalesce(F.col("dispatch") != "LOAD", F.lit(True))).alias("n_units"),
        F.sort_array(F.collect_set("unit")).alias("units"), F.coalesce(F.bool_or(F.col("schedule") == "SEMI-SCHEDULED"), F.lit(False)).alias("semi"),
        F.coalesce(F.bool_or(F.col("dispatch") == "LOAD"), F.lit(False)).alias("has_load"), F.coalesce(F.bool_or(F.col("dispatch") == "BIDIRECTIONAL"), F.lit(False)).alias("both_ways"),
    )

    def tried(priority: int, kind: str, value: Column) -> Column:
        return F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), value.alias("key"))

    code = F.upper("unit")
    tries = [tried(1, "code", F.upper("station")), tried(2, "name", normal_name(F.col("name"), NAME_WORDS)), tried(3, "code", code), tried(4, "code", without_unit_number(code))]
    keys = named.select("station", "unit", F.explode(F.array(*tries)).alias("t")).select("station", "unit", "t.*").where("key != ''")
    found = F.struct("code", "lat", "lon", "capacity")
    by_code = facilities.select(F.lit("code").alias("kind"), F.upper("code").alias("key"), found.alias("f"))
    by_name = facilities.select(F.lit("name").alias("kind"), normal_name(F.col("name"), NAME_WORDS).alias("key"), found.alias("f"))
    lookup = by_code.unionByName(by_name).where("key != ''").groupBy("kind", "key").agg(F.min("f").alias("f"))
    hits = keys.join(lookup, ["kind", "key"]).groupBy("station").agg(F.min(F.struct("priority", "unit", "f")).alias("hit"))
    return stations.join(hits, "station", "left").select(*stations.columns, F.col("hit.priority").alias("found_by"), "hit.f.code", "hit.f.lat", "hit.f.lon", "hit.f.capacity")


def modelled(stations: DataFrame, limit: int) -> DataFrame:
    """Which stations are modelled: the largest of each class, as many as its share of `limit`; ties by station."""
    fuel = F.col("fuel")
    kind = F.when(F.col("network") == "west", F.when(fuel.rlike("wind|solar"), "west")).otherwise(
        F.when(fuel == "wind", "wind").when(fuel.startswith("solar"), "solar").when(fuel.rlike("^(coal|gas)"), "thermal").when(fuel == "hydro", "hydro")
    )
    wanted = F.create_map(*[F.lit(x) for k, share in QUOTAS.items() for x in (k, int(limit * share + 0.5))])
    usable = F.col("class").isNotNull() & F.col("lat").isNotNull()
    rank = F.row_number().over(Window.partitionBy("class", usable).orderBy(F.coalesce("capacity", F.lit(0.0)).desc(), "station"))
    ranked = stations.withColumn("class", kind).withColumn("_n", rank)
    return ranked.withColumn("modelled", usable & F.coalesce(F.col("_n") <= F.element_at(wanted, F.col("class")), F.lit(False))).drop("_n", "class")


def registry(registrations: DataFrame, names: DataFrame, facilities: DataFrame, now: Column, limit: int = 60) -> DataFrame:
    """The whole build: units in force, their stations placed, the west's facilities as stations of their own, main fuels, the modelled fleet."""
    fuels = main_fuel(facilities)
    east = placed(in_force(registrations, now), names, facilities).withColumn("network", F.lit("east")).join(fuels, "code", "left")
    west = facilities.where("network = 'west'").join(fuels, "code").select(
        F.col("code").alias("station"), "name", F.lit("west").alias("region"), F.size("units").cast("long").alias("n_units"), F.array().cast("array<string>").alias("units"),
        ((F.col("fuel") == "wind") | F.col("fuel").startswith("solar")).alias("semi"), F.lit(False).alias("has_load"), F.lit(False).alias("both_ways"),
        F.lit(None).cast("int").alias("found_by"), "code", "lat", "lon", "capacity", F.lit("west").alias("network"), "fuel",
    )
    battery = F.when(F.col("both_ways"), "both ways").when(F.col("has_load"), "split").otherwise("ambiguous")
    out = east.unionByName(west).withColumn("battery", F.when(F.col("fuel").startswith("battery"), battery)).drop("has_load", "both_ways")
    return modelled(out, limit)


def match_codes(facilities: DataFrame, stations: DataFrame) -> DataFrame:
    """Facilities (facility, ...) with the station (code, battery) whose tokens they hold one after another, the longest code first.

    Every run of a facility's tokens is looked up by equality, so there is no theta join. A storage unit under a station that
    is no battery is left without one; so is a facility that holds no station's tokens.
    """
    tokens = F.split("facility", "_")
    starts = F.sequence(F.lit(1), F.size(tokens))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.size(tokens) - i + 1), lambda n: F.array_join(F.slice(tokens, i, n), "_"))))
    keys = facilities.select("facility", F.explode(F.array_distinct(runs)).alias("code")).distinct()
    best = keys.join(stations.select("code", "battery").distinct(), "code").groupBy("facility").agg(F.min(F.struct((-F.length("code")).alias("n"), "code", "battery")).alias("s"))
    stored = F.exists(tokens, lambda t: t.rlike(STORAGE))
    station = F.when(stored & ~F.coalesce(F.col("s.battery"), F.lit(False)), None).otherwise(F.col("s.code"))
    return facilities.join(best, "facility", "left").withColumn("station", station).withColumn("stored_apart", F.coalesce(stored & F.col("s.code").isNotNull() & station.isNull(), F.lit(False))).drop("s")
