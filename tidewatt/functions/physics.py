"""Weather and power-curve arithmetic, column to column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gas constant of dry air, zero Celsius, limits of turbines and panels.
GAS_CONSTANT = 287.05
KELVIN = 273.15
CUT_IN, CUT_OUT = 3.0, 25.0
WIND_DEFAULT = (0.0, 0.98, 0.62, 9.5)
SOLAR_DEFAULT = (0.95, 0.004)
LEAST_CLEAR_SKY = 20.0


def air_density(pascal: Column, celsius: Column) -> Column:
    return pascal / (F.lit(GAS_CONSTANT) * (celsius + KELVIN))


def wind_power(density: Column, speed: Column) -> Column:
    return density * F.pow(speed, F.lit(3)) * 0.5


def wind_shear(speed_high: Column, speed_low: Column) -> Column:
    """Shear exponent between 100 m and 10 m; 0 in a calm."""
    return F.when((speed_high > 0) & (speed_low > 0), F.log10(speed_high / speed_low)).otherwise(0.0)


def solar_zenith(lat: Column, lon: Column, ts: Column) -> Column:
    """Zenith angle in radians at a UTC time, by equation of time, declination and hour angle."""
    minutes = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60
    g = F.lit(2 * 3.141592653589793 / 365) * (F.dayofyear(ts) - 1 + (minutes / 60 - 12) / 24)
    eqtime = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    hour = F.radians((minutes + eqtime + 4 * lon) / 4 - 180)
    cos = F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(hour)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))


def clear_sky_ghi(cos_zenith: Column) -> Column:
    """Haurwitz' clear-sky irradiance; 0 below the horizon."""
    return F.when(cos_zenith <= 0, 0.0).otherwise(1098.0 * cos_zenith * F.exp(-0.057 / F.when(cos_zenith > 0, cos_zenith)))


def clear_sky_index(ghi: Column, clear: Column) -> Column:
    """Irradiance over clear-sky irradiance, not capped; 0 in the dark."""
    return F.when(clear < LEAST_CLEAR_SKY, 0.0).otherwise(F.try_divide(ghi, clear))


def wind_fraction(speed: Column, params: tuple = WIND_DEFAULT, cut_out: float = CUT_OUT) -> Column:
    """Share of capacity at a speed: a four-parameter logistic between cut-in and cut-out."""
    low, high, slope, middle = params
    curve = low + (high - low) / (1 + F.exp(-slope * (speed - middle)))
    return F.when((speed < CUT_IN) | (speed >= cut_out), 0.0).otherwise(curve)


def solar_fraction(index: Column, clear: Column, celsius: Column, params: tuple = SOLAR_DEFAULT) -> Column:
    """Share of capacity of a panel, less for heat of the cell over 25 degrees."""
    gain, loss = params
    ghi = index * clear
    return gain * (ghi / 1000) * (1 - loss * F.greatest(F.lit(0.0), celsius + ghi / 40 - 25))


def symlog(v: Column, threshold: float = 10.0) -> Column:
    return F.when(F.abs(v) <= threshold, v / threshold).otherwise(F.signum(v) * (1 + F.log10(F.abs(v) / threshold)))


def symlog_inverse(y: Column, threshold: float = 10.0) -> Column:
    """What `symlog` takes to y."""
    return F.when(F.abs(y) <= 1, y * threshold).otherwise(F.signum(y) * threshold * F.pow(F.lit(10.0), F.abs(y) - 1))


def clipped(x: Column, capacity: Column) -> Column:
    """An output between 0 and capacity. What is no number is 0, null stays; of an unknown capacity (null or no number) only 0 counts."""
    top = F.when(capacity.isNull() | F.isnan(capacity), F.lit(float("inf"))).otherwise(capacity)
    return F.when(x.isNotNull(), F.least(F.greatest(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)), top))


def huber(residual: Column, delta: float = 0.08) -> Column:
    return F.when(F.abs(residual) <= delta, residual * residual * 0.5).otherwise(delta * (F.abs(residual) - delta / 2))


def round3(v: Column) -> Column:
    """To 3 places, halves up; null stays."""
    return F.floor(v * 1000 + 0.5) / 1000
