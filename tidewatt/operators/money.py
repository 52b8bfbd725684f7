"""Prices and revenue of stations and regions, two feeds reconciled, and exact ranks and quantiles of groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import rank_in_group

#: Dollars a megawatt hour above which a price is a spike.
SPIKE = 300.0
MINUTES = 5.0
#: Forecasts that must have been scored before a skill is told.
LEAST_SCORED = 50


def _finite(value: Column, what: str) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == math.inf)
    return F.when(~bad, value).otherwise(F.raise_error(F.lit(f"{what} is not a number")).cast("double"))


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`rows` with `rank`, from 1 in the group, and `n`, the group's size: a group is ranked over any number of tasks."""
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"))
    return rank_in_group(rows, F.to_json(F.struct(group)), order).join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def exact_quantiles(rows: DataFrame, group: str, value: str, levels: dict[str, float]) -> DataFrame:
    """Per group: `n`, and for each name its level's quantile on the line between the two values about it (R's type 7).

    Null values are left out. Of a group at most two rows a level are brought together, after the ranks are known.
    """
    found = ranked(rows.where(F.col(value).isNotNull()), group, [F.col(value).asc()])
    marks = {name: (F.col("n") - 1) * level for name, level in levels.items()}
    wanted = []
    for at in marks.values():
        wanted += [F.col("rank") == F.floor(at) + 1, F.col("rank") == F.ceil(at) + 1]
    needed = F.lit(False)
    for w in wanted:
        needed = needed | w
    each = []
    for name, at in marks.items():
        low, high = (F.max(F.when(F.col("rank") == f(at) + 1, F.col(value))) for f in (F.floor, F.ceil))
        each.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return found.where(needed).groupBy(group).agg(F.max("n").alias("n"), *each)


def average_ranks(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """`rows` with the rank of their value in the group, equal values sharing the mean of theirs."""
    found = rank_in_group(rows, F.to_json(F.struct(group)), [F.col(value).asc()])
    shared = found.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.avg("rank").alias(name))
    return rows.join(shared, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def price_summary(prices: DataFrame, minutes: float = MINUTES) -> DataFrame:
    """Per region of prices (region, rrp): count, mean, median, p5, p95, min, max, negative and spike intervals, negative hours.
    Nothing is filtered: administered and intervened prices count like others; a price that is no number fails."""
    told = prices.select("region", _finite(F.col("rrp"), "a price").alias("rrp"))
    sums = told.groupBy("region").agg(
        F.count("*").alias("count"), F.avg("rrp").alias("mean"), F.min("rrp").alias("min"), F.max("rrp").alias("max"),
        F.count_if(F.col("rrp") < 0).alias("negative_intervals"), F.count_if(F.col("rrp") > SPIKE).alias("above_300_intervals"),
    )
    marks = exact_quantiles(told, "region", "rrp", {"median": 0.5, "p5": 0.05, "p95": 0.95}).drop("n").withColumnRenamed("region", "_r")
    return sums.join(marks, F.col("region").eqNullSafe(F.col("_r"))).drop("_r").withColumn("negative_hours", F.col("negative_intervals") * minutes / 60)


def station_revenue(observations: DataFrame, prices: DataFrame, minutes: float = MINUTES, basis: str = "spot energy") -> DataFrame:
    """Per station of observations (station, region, settlement, mw) at prices (region, settlement, rrp, apc): total, energy_mwh,
    negative_hours, negative_revenue, mean_rrp, captured_price, priced, unpriced, administered, region, basis.

    Observations meet prices by settlement within their region; those without a price are counted and not valued. An observation
    that is keyed by when it was observed is refused, as that is not the instant it is settled at. A priced
    observation without a finite output or price fails. Prices are one a region and settlement; two fail.
    """
    if "settlement" not in observations.columns:
        raise ValueError("observations need their settlement; the time of observation is another instant")
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    once = prices.groupBy("region", "settlement").agg(F.any_value("rrp").alias("rrp"), F.any_value("apc").alias("apc"), F.count("*").alias("_n"))
    rrp = F.when(F.col("_n") == 1, _finite(F.col("rrp"), "a price")).otherwise(F.raise_error(F.lit("two prices for an interval")).cast("double"))
    rows = observations.select("station", "region", "settlement", "mw").join(once, ["region", "settlement"], "left")
    priced = F.col("_n").isNotNull()
    rows = rows.select("station", "region", priced.alias("priced"), F.when(priced, rrp).alias("rrp"), F.when(priced, _finite(F.col("mw"), "an output") * minutes / 60).alias("mwh"), F.coalesce(priced & F.col("apc"), F.lit(False)).alias("apc"))
    low, dollars = F.col("rrp") < 0, F.col("mwh") * F.col("rrp")
    out = rows.groupBy("station", "region").agg(
        F.coalesce(F.sum(dollars), F.lit(0.0)).alias("total"), F.coalesce(F.sum("mwh"), F.lit(0.0)).alias("energy_mwh"), (F.count_if(low) * minutes / 60).alias("negative_hours"),
        F.coalesce(F.sum(F.when(low, dollars)), F.lit(0.0)).alias("negative_revenue"), F.avg("rrp").alias("mean_rrp"), F.count_if("priced").alias("priced"),
        F.count_if(~F.col("priced")).alias("unpriced"), F.count_if("apc").alias("administered"),
    )
    captured = F.try_divide("total", F.nullif("energy_mwh", F.lit(0.0)))
    return out.withColumns({"captured_price": captured, "basis": F.lit(basis)})


def region_revenue(stations: DataFrame) -> DataFrame:
    """Per region of `station_revenue` rows: stations, total, energy_mwh, negative_revenue, negative_hours (the widest of any station,
    since all see one price), captured_price by energy. A row without region and stations of one region on several bases fail."""
    region = F.when(F.col("region").isNotNull() & (F.col("region").cast("string") != ""), F.col("region")).otherwise(F.raise_error(F.lit("a station without region")).cast(stations.schema["region"].dataType))
    out = stations.withColumn("region", region).groupBy("region").agg(
        F.count("*").alias("stations"), F.sum("total").alias("total"), F.sum("energy_mwh").alias("energy_mwh"), F.sum("negative_revenue").alias("negative_revenue"),
        F.max("negative_hours").alias("negative_hours"), F.min("basis").alias("basis"), F.max("basis").alias("_basis"),
    )
    one = F.when(F.col("basis").eqNullSafe(F.col("_basis")), F.col("basis")).otherwise(F.raise_error(F.lit("stations on several price bases do not add up")).cast("string"))
    return out.withColumns({"basis": one, "captured_price": F.try_divide("total", F.nullif("energy_mwh", F.lit(0.0)))}).drop("_basis")


def reconciled(units: DataFrame, regions: DataFrame, step: int = 300) -> DataFrame:
    """Units (region, at, semi, mw) against the market's regional sums (region, at, generation, semi_cleared) of the interval before: ours, theirs
    and their scheduled parts, diff_pct (0 where theirs is 0) and `worst`, the instant's region of the largest absolute difference.

    A unit's reading stamped S was taken a step before, so it is held against the sum for the end of that interval. The market's
    generation holds the semi-scheduled part already. Regions without units count as 0 of ours; instants without sums are left out.
    """
    ours = units.groupBy("region", (F.col("at") - step).alias("at")).agg(F.sum(F.when(~F.col("semi"), F.col("mw"))).alias("ours_scheduled"), F.sum(F.when(F.col("semi"), F.col("mw"))).alias("ours_semi"))
    known = units.select((F.col("at") - step).alias("at")).distinct()
    theirs = regions.join(known, "at", "left_semi").select("region", "at", F.coalesce("generation", F.lit(0.0)).alias("theirs"), F.coalesce("semi_cleared", F.lit(0.0)).alias("theirs_semi"))
    rows = theirs.join(ours, ["region", "at"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ours_scheduled", "ours_semi")})
    rows = rows.withColumn("ours", F.col("ours_scheduled") + F.col("ours_semi")).withColumn("theirs_scheduled", F.col("theirs") - F.col("theirs_semi"))
    rows = rows.withColumn("diff_pct", F.when(F.col("theirs") == 0, 0.0).otherwise(100 * F.try_divide(F.col("ours") - F.col("theirs"), F.col("theirs"))))
    worst = rows.groupBy(F.col("at").alias("_at")).agg(F.max(F.struct(F.abs("diff_pct").alias("d"), F.col("region").alias("r")))["r"].alias("_worst"))
    return rows.join(worst, F.col("at") == F.col("_at")).withColumn("worst", F.col("region") == F.col("_worst")).drop("_at", "_worst")


# Fixed value: what a storage unit's code ends in.
STORAGE_UNIT = r"_(ESR|BESS)\d*$"


def station_of_code(codes: DataFrame, stations: DataFrame) -> DataFrame:
    """Codes (code) with `station`, the longest id of stations (station, fuel) that the code is or begins with, before `_` or a digit;
    null where there is none. A storage unit's code passes over stations that aren't batteries, and goes on to shorter ids.

    A code is cut at each place where an id may end, and the cuts are looked up by equality; codes are words, so cuts are few.
    """
    whole = F.array(F.struct(F.length("code").alias("n"), F.col("code").alias("id")))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("code") - 1)), lambda i: F.substring(F.col("code"), i + 1, F.lit(1)).rlike("[_0-9]"))
    cuts = F.concat(whole, F.transform(places, lambda i: F.struct(i.alias("n"), F.substring(F.col("code"), F.lit(1), i).alias("id"))))
    each = codes.select("code").where("code is not null").distinct().select("code", F.explode(cuts).alias("c")).select("code", "c.*")
    met = each.join(stations.select(F.col("station").alias("id"), "fuel"), "id")
    fits = ~F.col("code").rlike(STORAGE_UNIT) | F.coalesce(F.col("fuel").startswith("battery"), F.lit(False))
    best = met.where(fits).groupBy(F.col("code").alias("_code")).agg(F.max_by("id", "n").alias("station"))
    return codes.join(best, F.col("code") == F.col("_code"), "left").drop("_code")


def told_skill(n: Column, skill: Column, least: int = LEAST_SCORED) -> Column:
    """A skill, null where fewer forecasts than `least` were scored."""
    return F.when(n >= least, skill)
