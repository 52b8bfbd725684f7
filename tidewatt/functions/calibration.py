"""Whether forecasts are as uncertain as they say: histograms of the PIT, their test, shape and reliability."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# The levels of a reliability curve.
LEVELS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: The upper 5 % of chi-squared with 3 degrees of freedom, and of a standard normal either way.
FLAT_BELOW, SIGNIFICANT = 7.814728, 1.959964


def histogram(pit: Column, bins: int = 10) -> Column:
    """Aggregate: counts in equal bins, values outside 0 to 1 in the end bins, nulls in none."""
    at = F.when(pit.isNotNull(), F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(pit * bins))))
    return F.array(*[F.count_if(at == i) for i in range(bins)])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def shares(counts: Column) -> Column:
    """Each bin's share; all 0 of an empty histogram."""
    total = _sum(F.transform(counts, lambda c: c.cast("double")))
    return F.transform(counts, lambda c: F.coalesce(F.try_divide(c.cast("double"), total), F.lit(0.0)))


def bars(counts: Column) -> Column:
    """Heights against a flat histogram's 1."""
    return F.transform(shares(counts), lambda s: s * F.size(counts))


def chi_squared(counts: Column) -> Column:
    """Against equal bins; null of an empty histogram."""
    total = F.nullif(_sum(F.transform(counts, lambda c: c.cast("double"))), F.lit(0.0))
    each = total / F.size(counts)
    return _sum(F.transform(counts, lambda c: (c - each) * (c - each) / each))


def gamma_pair(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The regularised lower and upper incomplete gamma functions, for a > 0 and any x; 0 and 1 for x <= 0, not a number elsewhere.

    The smaller of the two keeps its digits where the other has been rounded to 1. Below a + 1 the lower tail's power series is summed, above the convergents of the fraction 1/(x+1-a- 1(1-a)/(x+3-a- ...)) are
    formed; each element goes on until it moves by no more than rounding.
    """
    a, x = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(a, x))
    out = np.where((a > 0) & ~np.isnan(x), 1.0, np.nan)
    todo = np.flatnonzero((a > 0) & (x > 0))
    out[todo[np.isinf(x[todo])]] = 0.0
    low_tail = 1.0 - out
    todo = todo[np.isfinite(x[todo])]
    front = np.exp(a[todo] * np.log(x[todo]) - x[todo] - np.array([math.lgamma(v) for v in a[todo]]))
    low = x[todo] < a[todo] + 1

    at, k = todo[low], 0
    term = 1.0 / a[at]
    total, live = term.copy(), np.ones(len(at), bool)
    while live.any():
        k += 1
        term[live] *= x[at][live] / (a[at][live] + k)
        total[live] += term[live]
        live &= term > 1e-17 * total
    low_tail[at] = front[low] * total
    out[at] = 1.0 - low_tail[at]

    at, k = todo[~low], 0
    u, v = a[at], x[at]
    p0, q0, p1, q1 = np.zeros(len(at)), np.ones(len(at)), np.ones(len(at)), v + 1 - u  # convergents p/q
    value, live = p1 / q1, np.ones(len(at), bool)
    while live.any():
        k += 1
        top, bottom = -k * (k - u), v + 2 * k + 1 - u
        p0, q0, p1, q1 = p1, q1, bottom * p1 + top * p0, bottom * q1 + top * q0
        size = np.maximum(np.abs(q1), 1e-300)
        p0, q0, p1, q1 = p0 / size, q0 / size, p1 / size, q1 / size
        new = np.where(live, p1 / np.where(q1 == 0, 1e-300, q1), value)
        live &= np.abs(new - value) > 1e-16 * np.abs(new)
        live &= top != 0  # for whole a the fraction ends
        value = new
    out[at] = front[~low] * value
    low_tail[at] = 1.0 - out[at]
    return np.clip(low_tail, 0.0, 1.0), np.clip(out, 0.0, 1.0)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function of `gamma_pair`."""
    return gamma_pair(a, x)[1]


@F.pandas_udf(StructType().add("lower", DoubleType()).add("upper", DoubleType()))
def gamma_tails(a: pd.Series, x: pd.Series) -> pd.DataFrame:
    """`gamma_pair` over a batch; both null where a or x is null or a <= 0."""
    lower, upper = gamma_pair(a.to_numpy(float, na_value=np.nan), x.to_numpy(float, na_value=np.nan))
    return pd.DataFrame({"lower": lower, "upper": upper})  # what is not a number becomes null


def gamma_above(more: Column, less: Column) -> Column:
    """Whether the first of two pairs of `gamma_tails` has the larger upper tail, told by those tails that are the smaller ones."""
    return F.when(less["lower"] < 0.5, more["lower"] < less["lower"]).otherwise(more["upper"] > less["upper"])


@F.pandas_udf(DoubleType())
def gamma_tail(a: pd.Series, x: pd.Series) -> pd.Series:
    """`upper_gamma` over a batch, for which Spark has no function. Null stays null, and so does a <= 0."""
    found = upper_gamma(a.to_numpy(float, na_value=np.nan), x.to_numpy(float, na_value=np.nan))
    return pd.Series(found).where(~np.isnan(found), None)


def chi_squared_tail(x: Column, freedom: Column) -> Column:
    """P(chi-squared with any positive degrees of freedom > x)."""
    return gamma_tail(freedom.cast("double") / 2, x.cast("double") / 2)


def legendre_terms(counts: Column, bins: int) -> list[Column]:
    """The first three components of a smooth test of uniformity: each is about standard normal where the bins are equally likely.

    They are the counts' sums against the Legendre polynomials of degree 1 to 3, averaged over a bin and scaled to unit variance."""
    edges = np.linspace(-1.0, 1.0, bins + 1)
    out, total = [], _sum(F.transform(counts, lambda c: c.cast("double")))
    for degree in (1, 2, 3):
        rise = np.polynomial.Legendre.basis(degree).integ()(edges)
        weights = np.diff(rise) * bins / 2
        weights /= math.sqrt(float((weights**2).mean())) or 1.0
        dot = F.aggregate(F.zip_with(counts, F.array(*[F.lit(float(w)) for w in weights]), lambda n, w: n * w), F.lit(0.0), lambda t, v: t + v)
        out.append(F.coalesce(F.try_divide(dot, F.sqrt(total)), F.lit(0.0)))
    return out


def shape(counts: Column, bins: int) -> Column:
    """What a histogram of at least 4 bins says of the forecasts, by the components of `legendre_terms`.

    Even if their squares sum to less than chance gives in 95 of 100 flat histograms. Else the first says to which side the mass
    leans, the second whether it lies in the ends or the middle, and the larger one decides; where the series doesn't fall off
    (each component significant, all of the sign of a point at one end, the later ones at least half the first), the mass is a
    point at that end.
    """
    lean, bow, turn = legendre_terms(counts, bins)
    count = _sum(F.transform(counts, lambda c: c.cast("double")))
    point = (F.abs(lean) > SIGNIFICANT) & (bow > F.greatest(F.lit(SIGNIFICANT), F.abs(lean) / 2)) & (F.abs(turn) > F.greatest(F.lit(SIGNIFICANT), F.abs(lean) / 2)) & (lean * turn > 0)
    sided = F.when(lean > 0, F.lit("low")).otherwise(F.lit("high"))
    end = F.when(lean > 0, F.lit("high")).otherwise(F.lit("low"))
    spread = F.when(bow > 0, F.lit("overconfident")).otherwise(F.lit("underconfident"))
    told = F.when(point, F.concat(F.lit("pinned-"), end)).when(F.abs(lean) > F.abs(bow), F.concat(F.lit("biased-"), sided)).otherwise(spread)
    return F.when(count == 0, "empty").when(lean * lean + bow * bow + turn * turn < FLAT_BELOW, "calibrated").otherwise(told)


def covered(counts: Column, bins: int, level: float) -> Column:
    """Share within a central band, read off a histogram; a bin that lies partly within counts in that part."""
    lo, hi, s = (1 - level) / 2, (1 + level) / 2, shares(counts)
    return sum((s[i] * max(0.0, min(hi * bins, i + 1) - max(lo * bins, i)) for i in range(bins)), F.lit(0.0))


def covered_exactly(pit: Column, level: float) -> Column:
    """Aggregate: share of values within a central band, its ends included; 0 of none."""
    return F.coalesce(F.avg(pit.between((1 - level) / 2, (1 + level) / 2).cast("int")), F.lit(0.0))
