"""Proper scores and money of quantile forecasts, column to column.

A quantile forecast is an array of structs (q, v) in ascending q.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinball(level: Column, predicted: Column, actual: Column) -> Column:
    return F.when(actual >= predicted, level * (actual - predicted)).otherwise((1 - level) * (predicted - actual))


def crps(quantiles: Column, actual: Column) -> Column:
    """Twice the mean pinball loss over the levels."""
    losses = F.transform(quantiles, lambda x: pinball(x["q"], x["v"], actual))
    return F.try_divide(2 * F.aggregate(losses, F.lit(0.0), lambda a, x: a + x), F.size(quantiles))


def crps_of_samples(samples: Column, actual: Column) -> Column:
    """Ensemble CRPS in the sorted energy form: linear after the sort."""
    n, s = F.size(samples), F.array_sort(samples)
    near = F.aggregate(F.transform(s, lambda x: F.abs(x - actual)), F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(F.transform(s, lambda x, i: (2 * i + 1 - n) * x), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(near, n) - F.try_divide(spread, n * n)


def skill(model: Column, base: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise(1 - F.try_divide(model, base))


def pit(quantiles: Column, actual: Column) -> Column:
    """Probability of the actual value: linear between knots, half of the tail outside; on an atom the upper level."""
    first, last = F.element_at(quantiles, 1), F.element_at(quantiles, -1)
    pairs = F.arrays_zip(F.slice(quantiles, F.lit(1), F.size(quantiles) - 1).alias("a"), F.slice(quantiles, F.lit(2), F.size(quantiles) - 1).alias("b"))
    inside = F.element_at(F.filter(pairs, lambda p: (p["a"]["v"] <= actual) & (actual <= p["b"]["v"])), -1)

    def between(p: Column) -> Column:
        width = p["b"]["v"] - p["a"]["v"]
        return F.when(width == 0, p["b"]["q"]).otherwise(p["a"]["q"] + (p["b"]["q"] - p["a"]["q"]) * F.try_divide(actual - p["a"]["v"], width))

    found = F.get(F.transform(F.array(inside), between), F.lit(0))  # a lambda's variable, so that the search runs once
    return F.when(actual < first["v"], first["q"] / 2).when(actual > last["v"], (1 + last["q"]) / 2).otherwise(found)


def energy_mwh(mw: Column, minutes: float = 5.0) -> Column:
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    return mw * minutes / 60


def revenue(mw: Column, price: Column, minutes: float = 5.0) -> Column:
    return energy_mwh(mw, minutes) * price


def mark_to_market(mwh: Column, price: Column, entry: Column) -> Column:
    return mwh * (price - entry)


def spill_reason(price: Column, capped: Column) -> Column:
    return F.when(price < 0, "negative_price").when(capped, "dispatch_cap").when(~capped, "unexplained").otherwise("unknown")


def confidence(skill_: Column, band: Column, capacity: Column, masked: Column) -> Column:
    """Between 0 and 1: skill over one half, times how narrow the band is, times how much is unmasked."""

    def unit(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    return unit(skill_ / 0.5) * unit(1 - F.try_divide(band, capacity)) * unit(1 - masked)


def price_assumption(rrp: Column, basis: Column | None = None, minutes: Column | None = None) -> Column:
    """Struct (rrp, basis, minutes) of a price that forecasts are valued at: a flat price is told as such, an interval is five minutes
    unless given. A price that is no finite number fails."""
    bad = rrp.isNull() | F.isnan(rrp) | (F.abs(rrp) == float("inf"))
    price = F.when(bad, F.raise_error(F.lit("the assumed price is not a number")).cast("double")).otherwise(rrp.cast("double"))
    whole = price == F.floor(price)
    flat = F.concat(F.lit("flat $"), F.when(whole, price.cast("long").cast("string")).otherwise(price.cast("string")), F.lit("/MWh across every forecast interval"))
    return F.struct(price.alias("rrp"), F.coalesce(basis if basis is not None else F.lit(None), flat).alias("basis"), F.coalesce(minutes if minutes is not None else F.lit(None), F.lit(5.0)).alias("minutes"))


def checked(quantiles: Column) -> Column:
    """The quantiles in ascending level. Fails if there are none, a level is outside 0 to 1 or given twice, or values cross."""
    def usable(s: Column) -> Column:
        unusable = F.exists(s, lambda x: x["q"].isNull() | x["v"].isNull() | F.isnan(x["v"]) | (x["q"] <= 0) | (x["q"] >= 1))
        steps = F.transform(s, lambda x, i: F.when(i > 0, (x["q"] == F.get(s, i - 1)["q"]) | (x["v"] < F.get(s, i - 1)["v"])).otherwise(F.lit(False)))
        return F.when((F.size(s) < 1) | unusable | F.exists(steps, lambda x: x), F.raise_error(F.lit("not a set of quantiles"))).otherwise(s)

    return F.get(F.transform(F.array(F.array_sort(quantiles)), usable), 0)


def quantile_mean(quantiles: Column) -> Column:
    """Mean of a distribution whose mass lies on its quantiles, each taking what is nearest in level; flat tails."""
    n = F.size(quantiles)

    def share(x: Column, i: Column) -> Column:
        before, after = F.get(quantiles, i - 1)["q"], F.get(quantiles, i + 1)["q"]
        return x["v"] * (F.when(i == n - 1, 1.0).otherwise((x["q"] + after) / 2) - F.when(i == 0, 0.0).otherwise((before + x["q"]) / 2))

    return F.aggregate(F.transform(quantiles, share), F.lit(0.0), lambda a, x: a + x)


def quantile_at(quantiles: Column, level: float) -> Column:
    """The value at a level, on the line between its neighbours; the ends are held."""
    below = F.element_at(F.filter(quantiles, lambda x: x["q"] <= level), -1)
    above = F.element_at(F.filter(quantiles, lambda x: x["q"] >= level), 1)
    lo, hi = F.when(F.exists(quantiles, lambda x: x["q"] <= level), below), F.when(F.exists(quantiles, lambda x: x["q"] >= level), above)
    line = lo["v"] + (hi["v"] - lo["v"]) * F.coalesce(F.try_divide(level - lo["q"], hi["q"] - lo["q"]), F.lit(0.0))
    return F.coalesce(line, lo["v"], hi["v"])


def revenue_band(quantiles: Column, price: Column, capacity: Column, minutes: float = 5.0) -> Column:
    """Struct (expected, p10, p90, per_mw) in dollars of a generation forecast at one price.

    Generation is held to 0 and capacity. At a price below 0 the order turns: level q becomes 1 - q. A capacity that is
    not above 0, a missing price and unusable quantiles fail.
    """
    cap = F.when(capacity > 0, capacity).otherwise(F.raise_error(F.lit("capacity must be positive")))
    rate = energy_mwh(F.lit(1.0), minutes) * F.coalesce(price, F.raise_error(F.lit("price is missing")).cast("double"))

    def valued(x: Column) -> Column:
        q = F.when(rate < 0, 1 - x["q"]).otherwise(x["q"])
        return F.struct(q.alias("q"), (F.least(cap, F.greatest(F.lit(0.0), x["v"])) * rate).alias("v"))

    def told(d: Column) -> Column:
        return F.struct(quantile_mean(d).alias("expected"), quantile_at(d, 0.1).alias("p10"), quantile_at(d, 0.9).alias("p90"), (quantile_mean(d) / cap).alias("per_mw"))

    # an array of one, so that the sorted dollars are worked out once a row and not wherever they are named
    return F.get(F.transform(F.array(F.array_sort(F.transform(checked(quantiles), valued))), told), 0)
