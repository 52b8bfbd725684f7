"""What a model is fed for a fuel, and fitted curves: checked, sampled, marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import physics

# Fuels by what drives them.
THERMAL = "coal_black coal_brown gas_ccgt gas_ocgt gas_steam gas_recip distillate hydro bioenergy".split()
STORAGE = "battery_charging battery_discharging pumps".split()
# The middle or scale of a feature.
POWER_SCALE, SPEED_SCALE, DENSITY_SCALE = 1000.0, 15.0, 1.225
PANEL_TEMPERATURE, ROOM_TEMPERATURE, HOT = 25.0, 20.0, 30.0


def _or(weather: Column, name: str, neutral: float = 0.0) -> Column:
    """A variable of the weather; `neutral` where it is null or not finite."""
    v = weather[name].cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(neutral)).otherwise(v)


def _mapped(values: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("double") for v in values.values()]))


def solar_features(weather: Column, lat: Column, lon: Column, at: Column) -> Column:
    cos = F.greatest(F.lit(0.0), F.cos(physics.solar_zenith(lat, lon, at)))
    clear, ghi = physics.clear_sky_ghi(cos), _or(weather, "shortwave_radiation")
    return _mapped({
        "clear_sky_index": physics.clear_sky_index(ghi, clear), "clear_sky_ghi": clear / 1000, "cos_zenith": cos,
        "beam_normal": _or(weather, "direct_normal_irradiance") / 1000,
        "diffuse_fraction": F.when(ghi > physics.LEAST_CLEAR_SKY, F.try_divide(_or(weather, "diffuse_radiation"), ghi)).otherwise(0.0),
        **{f"cloud_cover_{height}": _or(weather, f"cloud_cover_{height}") / 100 for height in ("low", "mid", "high")},
        "temp_derate": (_or(weather, "temperature_2m", PANEL_TEMPERATURE) - PANEL_TEMPERATURE) / PANEL_TEMPERATURE,
    })


def wind_features(weather: Column) -> Column:
    high, low = _or(weather, "wind_speed_100m"), _or(weather, "wind_speed_10m")
    density = physics.air_density(_or(weather, "surface_pressure", 1013.0) * 100, _or(weather, "temperature_2m", 15.0))
    towards = F.radians(_or(weather, "wind_direction_100m"))
    return _mapped({
        "wind_power": physics.wind_power(density, high) / POWER_SCALE, "wind_speed_100m": high / SPEED_SCALE, "wind_shear": physics.wind_shear(high, low),
        "wind_dir_sin": F.sin(towards), "wind_dir_cos": F.cos(towards), "air_density": density / DENSITY_SCALE,
    })


def thermal_features(weather: Column) -> Column:
    warm = _or(weather, "temperature_2m", ROOM_TEMPERATURE)
    return _mapped({
        "temperature_2m": (warm - ROOM_TEMPERATURE) / ROOM_TEMPERATURE, "relative_humidity_2m": _or(weather, "relative_humidity_2m", 50.0) / 100,
        "cooling_degrees": F.greatest(F.lit(0.0), warm - HOT) / ROOM_TEMPERATURE,
    })


def features(fuel: Column, weather: Column, lat: Column, lon: Column, at: Column) -> Column:
    """A map from a feature's name to its value: nine for solar, six for wind, three for thermal fuels and hydro, none for
    what follows the price alone. Missing variables take neutral values; a fuel that isn't known, null too, is refused."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    refused = F.raise_error(F.concat(F.lit("no features for fuel "), F.coalesce(fuel, F.lit("null")))).cast("map<string,double>")
    return (
        F.when(fuel == "solar_utility", solar_features(weather, lat, lon, at)).when(fuel == "wind", wind_features(weather))
        .when(fuel.isin(THERMAL), thermal_features(weather)).when(fuel.isin(STORAGE), none).otherwise(refused)
    )


def _finite(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def usable_curve(fuel: Column, curve: Column) -> Column:
    """A struct of the parameters to run a fitted curve by, or null where the fit has failed or lacks one of them.

    `curve` has converged, cut_out and params (y_min, y_max, k, v50, gain, temp_coeff). A wind curve keeps its cut-out, null if
    none was seen; a solar curve without a heat coefficient takes the default one. Fuels without a curve get null.
    """
    p = curve["params"]
    fine = curve.isNotNull() & ~curve["converged"].eqNullSafe(F.lit(False)) & p.isNotNull()
    wind = [p[n] for n in ("y_min", "y_max", "k", "v50")]
    whole = wind[0].isNotNull()
    for v in wind:
        whole = whole & _finite(v)
    nothing = F.lit(None).cast("double")

    def struct(*values: Column) -> Column:
        names = ("y_min", "y_max", "k", "v50", "cut_out", "gain", "temp_coeff")
        return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])

    cut = F.when(_finite(curve["cut_out"]), curve["cut_out"])
    heat = F.when(_finite(p["temp_coeff"]), p["temp_coeff"]).otherwise(physics.SOLAR_DEFAULT[1])
    return F.when(fine & (fuel == "wind") & whole, struct(*wind, cut, nothing, nothing)).when(
        fine & (fuel == "solar_utility") & _finite(p["gain"]), struct(nothing, nothing, nothing, nothing, nothing, p["gain"], heat)
    )


def sampled(curves: DataFrame, keys: list[str], samples: int = 160) -> DataFrame:
    """Rows (keys, i, x, y) of a wind curve at equally spaced speeds from x_min to x_max, in MW.

    `curves` has keys, curve (as `usable_curve` gives it), capacity, x_min, x_max. From the cut-out on output is 0. There are no
    rows where there is no curve, no positive capacity or no range.
    """
    c = F.col("curve")
    drawn = curves.where(c.isNotNull() & c["v50"].isNotNull() & _finite(F.col("capacity")) & (F.col("capacity") > 0) & _finite(F.col("x_min")) & _finite(F.col("x_max")) & (F.col("x_max") > F.col("x_min")))
    points = drawn.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    points = points.withColumn("x", F.col("x_min") + (F.col("x_max") - F.col("x_min")) * (F.col("i") / (samples - 1)))
    share = c["y_min"] + (c["y_max"] - c["y_min"]) / (1 + F.exp(-c["k"] * (F.col("x") - c["v50"])))
    held = F.greatest(F.lit(0.0), F.least(F.col("capacity"), F.col("capacity") * share))
    return points.select(*keys, "i", "x", F.when(c["cut_out"].isNotNull() & (F.col("x") >= c["cut_out"]), 0.0).otherwise(held).alias("y"))


def marks(converged: Column, named_speeds: dict[str, Column]) -> Column:
    """An array of (x, label) of those named speeds that the fit has found; empty where it failed."""
    all_ = F.array(*[F.struct(v.cast("double").alias("x"), F.lit(k).alias("label")) for k, v in named_speeds.items()])
    return F.filter(all_, lambda m: F.coalesce(converged, F.lit(False)) & m["x"].isNotNull() & ~F.isnan(m["x"]) & (F.abs(m["x"]) != float("inf")))


def derived(weather: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows of weather (station, at in seconds, variables) with what follows from them: air_density, wind_power, wind_shear,
    clear_sky_ghi, clear_sky_index, solar_zenith. A column is null where one of the variables it needs is missing from
    the table, null or not finite. Stations are (station, lat, lon); rows of others drop out."""

    def value(name: str) -> Column:
        v = F.col(name).cast("double") if name in weather.columns else F.lit(None).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    high, sun, at = value("wind_speed_100m"), value("shortwave_radiation"), F.timestamp_seconds("at")
    density = physics.air_density(value("surface_pressure") * 100, value("temperature_2m"))
    placed = weather.join(stations.select("station", "lat", "lon"), "station")
    zenith = F.when(sun.isNotNull(), physics.solar_zenith(F.col("lat"), F.col("lon"), at))
    shear = F.when(high.isNotNull() & value("wind_speed_10m").isNotNull(), physics.wind_shear(high, value("wind_speed_10m")))
    out = placed.withColumns({"air_density": density, "wind_power": physics.wind_power(density, high), "wind_shear": shear, "solar_zenith": zenith})
    out = out.withColumn("clear_sky_ghi", F.when(F.col("solar_zenith").isNotNull(), physics.clear_sky_ghi(F.cos("solar_zenith"))))
    return out.withColumn("clear_sky_index", F.when(F.col("clear_sky_ghi").isNotNull(), physics.clear_sky_index(sun, F.col("clear_sky_ghi")))).drop("lat", "lon")
