"""Fleet-wide readings: usability, eligibility, pivots and audits of skill, enrichments, bands, coverage of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stations under so many MW are not modelled.
LEAST_CAPACITY = 5.0
#: A coverage is breached when it is further than this from its nominal level.
COVERAGE_SLACK = 0.03
#: A feed is taken as stopped after so many minutes.
STALE_MINUTES = 15
#: The order in which fuels are stacked.
STACK = "coal_black coal_brown gas_ccgt gas_steam bioenergy hydro wind solar_utility gas_recip gas_ocgt distillate battery_discharging pumps battery_charging".split()


def live_use(quality: Column, capped: Column) -> Column:
    """What a live row may be used for: `none` if suspect or capped, `fit` if it is known not to be capped, else `score`."""
    return F.when((quality.eqNullSafe(F.lit("suspect"))) | capped.eqNullSafe(F.lit(True)), "none").when(capped.isNotNull(), "fit").otherwise("score")


def eligible(codes: Column, located: Column, capacity: Column) -> Column:
    """Whether a station can be modelled: it has codes in the feed, a place, and LEAST_CAPACITY at least."""
    return F.coalesce((F.size(codes) > 0) & located & (capacity >= LEAST_CAPACITY), F.lit(False))


def match_rate(stations: DataFrame) -> DataFrame:
    """One row of (stations, modelled, capacity_mw, modelled_mw, percent) over stations (codes, located, capacity)."""
    mw, fits = F.coalesce("capacity", F.lit(0.0)), eligible(F.col("codes"), F.col("located"), F.col("capacity"))
    out = stations.agg(
        F.count("*").alias("stations"), F.count_if(fits).alias("modelled"), F.coalesce(F.sum(mw), F.lit(0.0)).alias("capacity_mw"),
        F.coalesce(F.sum(F.when(fits, mw)), F.lit(0.0)).alias("modelled_mw"),
    )
    return out.withColumn("percent", F.try_divide(100 * F.col("modelled_mw"), F.col("capacity_mw")))


def clipped_history(rows: DataFrame, bands: list[str], capacity: Column) -> DataFrame:
    """Rows whose `at` is over 0, bands held between 0 and the fleet's capacity (no upper limit where it is null or not
    positive). Values that are not finite become null."""
    out = rows.where(F.col("at") > 0)
    for c in bands:
        v = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.greatest(F.lit(0.0), F.col(c)))
        out = out.withColumn(c, F.when(capacity > 0, F.when(v.isNotNull(), F.least(v, capacity))).otherwise(v))
    return out


def coverage_breached(coverage: Column, nominal: float = 0.9, slack: float = COVERAGE_SLACK) -> Column:
    return F.abs(coverage - nominal) > slack


def skill_by_fuel(scores: DataFrame, horizons: list[str]) -> DataFrame:
    """A row a fuel with its median skill at each horizon and its stations, from scores (station, fuel, horizon, skill). Horizons
    are named so that the pivot needs no pass to find them."""
    wide = scores.groupBy("fuel").pivot("horizon", horizons).agg(F.median("skill"))
    return wide.join(scores.groupBy("fuel").agg(F.count_distinct("station").alias("stations")), "fuel")


def always_positive(scores: DataFrame) -> DataFrame:
    """One row (stations, positive, share): stations whose skill is over 0 at every horizon at which it is known."""
    each = scores.groupBy("station").agg(F.coalesce(F.bool_and(F.col("skill") > 0), F.lit(True)).alias("good"))
    return each.agg(F.count("*").alias("stations"), F.count_if("good").alias("positive")).withColumn("share", F.try_divide("positive", "stations"))


def by_interval(observations: DataFrame) -> DataFrame:
    """A row an instant: its observations as an array in the order of stations. A fleet bounds its length."""
    rest = [c for c in observations.columns if c not in ("station", "at")]
    held = observations.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("station", *rest))).alias("observations"))
    return held.withColumn("n", F.size("observations").cast("long"))


def with_entry(maps: DataFrame, extra: DataFrame, name: str, at: str = "at", column: str = "demand") -> DataFrame:
    """`maps` with `name` put in the map `column` where `extra` (at, value) has a value for the instant; others stay as they are."""
    one = extra.where("value is not null").groupBy(at).agg(F.max("value").alias("value"))
    entry = F.map_from_arrays(F.array(F.lit(name)), F.array("value"))
    rest = F.map_filter(column, lambda k, _: k != F.lit(name))
    return maps.join(one, at, "left").withColumn(column, F.when(F.col("value").isNotNull(), F.map_concat(rest, entry)).otherwise(F.col(column))).drop("value")


def in_stack_order(fuels: DataFrame, order: list[str] = STACK) -> DataFrame:
    """Fuels with `place`: known ones by `order`, others after them by name."""
    known = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("fuel"))
    return fuels.withColumn("place", F.when(known > 0, known).otherwise(len(order) + 1)).orderBy("place", "fuel")


def strongest_first(correlations: DataFrame, key: str) -> DataFrame:
    """A row a variable, the largest |r| over its lags first (values that aren't finite count as none), then by name: its peak lag
    is the first of the largest."""
    r = F.when(~F.isnan("r") & (F.abs("r") != float("inf")), F.abs("r"))
    peak = F.max_by("lag", F.when(r.isNotNull(), F.struct(r.alias("r"), F.negative(F.col("lag")).alias("l"))))
    return correlations.groupBy(key).agg(F.coalesce(F.max(r), F.lit(0.0)).alias("strength"), peak.alias("peak")).orderBy(F.desc("strength"), key)


def fleet_band(bands: DataFrame, n_stations: int) -> DataFrame:
    """A row (at, horizon) with the fleet's forecast and the half-width its band would have were stations independent: the root
    of the sum of squares. Instants at which a station has issued nothing are left out."""
    half = (F.col("hi") - F.col("lo")) / 2
    out = bands.groupBy("at", "horizon").agg(
        F.sum("mw").alias("mw"), F.sqrt(F.sum(half * half)).alias("independent_half"), F.sum(half).alias("summed_half"), F.count_distinct("station").alias("stations")
    )
    return out.where(F.col("stations") == n_stations)


def fleet_scored(readings: DataFrame, n_stations: int) -> DataFrame:
    """Instants with the fleet's output, `scored` where all its stations are there and usable."""
    out = readings.groupBy("at").agg(F.sum("mw").alias("mw"), F.count_distinct(F.when(F.col("usable"), F.col("station"))).alias("usable"))
    return out.select("at", "mw", (F.col("usable") == n_stations).alias("scored"))


def mixed_quantiles(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, quantiles): the arrays of all experts averaged by weight, level by level, from parts (keys, weight, quantiles)."""
    levels = parts.select(*keys, "weight", F.posexplode("quantiles").alias("i", "v")).groupBy(*keys, "i").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))
    held = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("q"))
    return held.select(*keys, F.transform("q", lambda x: x["v"]).alias("quantiles"))


def feed_status(feeds: DataFrame, now: Column) -> DataFrame:
    """Feeds (feed, absent, error, starting, latest in seconds) with `state`: absent, unreachable, starting, silent (nothing
    published yet), stopped (older than STALE_MINUTES) or live; and the age in whole minutes."""
    age = F.floor((now - F.col("latest")) / 60 + 0.5)
    state = (
        F.when(F.coalesce("absent", F.lit(False)), "absent").when(F.col("error").isNotNull(), "unreachable").when(F.coalesce("starting", F.lit(False)), "starting")
        .when(F.col("latest").isNull(), "silent").when(age > STALE_MINUTES, "stopped").otherwise("live")
    )
    return feeds.withColumn("state", state).withColumn("minutes", age)


def covered(manifest: DataFrame, version: int, stations: int) -> DataFrame:
    """Feeds with the sorted days held in a manifest (feed, day, version, stations); what another version or fleet wrote doesn't count."""
    good = manifest.where((F.col("version") == version) & (F.col("stations") == stations))
    days = good.groupBy("feed").agg(F.sort_array(F.collect_set("day")).alias("days"))
    return manifest.select("feed").distinct().join(days, "feed", "left").withColumn("days", F.coalesce("days", F.array().cast("array<string>")))


def ramps_since(rows: DataFrame, since: Column) -> DataFrame:
    """Rows (station, at, mw) after `since` with `ramp`, the change from the station's row before; the newest row at or before
    `since` gives the first its context and is then dropped. Of the older rows one a station enters the sort."""
    before = rows.where(F.col("at") <= since).groupBy("station").agg(F.max_by(F.struct("at", "mw"), "at").alias("r")).select("station", "r.*")
    both = before.unionByName(rows.where(F.col("at") > since).select("station", "at", "mw"))
    change = F.col("mw") - F.lag("mw").over(Window.partitionBy("station").orderBy("at"))
    return both.withColumn("ramp", change).where(F.col("at") > since)


def valued(outputs: DataFrame, prices: DataFrame) -> DataFrame:
    """Outputs (at in seconds, mw) with `price` of prices (at_ms, price) of the same instant, null where there is none."""
    return outputs.join(prices.select((F.col("at_ms") / 1000).cast("long").alias("at"), "price"), "at", "left")
