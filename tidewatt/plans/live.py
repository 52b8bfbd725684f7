"""Live readings, audits, folds of documents and curves over the driver's tables, with SQL for DuckDB written apart.

Surrogates: users modulo 12 are stations, events their readings; event types are horizons, fuels or regions as a query needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, stamps
from ..operators import fleet
from ..sources import nested

C = F.col
#: Horizons and regions of the surrogates.
TYPES = ["click", "purchase", "signup", "view"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", "user_id", (C("user_id") % 12).alias("station"), F.unix_timestamp(C("ts").cast("timestamp")).alias("at"), "event_type", "value")


def _slot(seconds: int = 300) -> Column:
    return F.floor(C("at") / seconds) * seconds


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat("p_name", F.lit(" (*/~+%'!) ä"), "p_brand")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", stamps.safe_name(odd).alias("safe"), (stamps.named(stamps.safe_name(odd)) == odd).alias("back"))


def stamp_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, stamp = C("at"), F.concat(F.replace(stamps.day_of(C("at")), F.lit("-"), F.lit("")), F.replace(stamps.clock_label(C("at"), hours=0), F.lit(":"), F.lit("")))
    return _events(spark, sf_dir).select(
        "event_id", stamps.day_of(at).alias("day"), stamps.day_start(stamps.day_of(at)).alias("start"), stamps.year_day(at).alias("year_day"), F.round(stamps.day_minutes(at), 4).alias("minutes"),
        stamps.clock_label(at).alias("clock"), stamps.clock_label(at, with_date=True).alias("label"), stamps.stamp_before(stamp).alias("before"), stamps.nearest_step(at).alias("nearest"),
    )


def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stamps.projected(113 + C("s_nationkey"), -44 + C("s_acctbal") / 500, (113.0, 154.0, -44.0, -10.0))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


def floor_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return held.select("user_id", stamps.floor_quantile(C("v"), 0.05).alias("low"), stamps.floor_quantile(C("v"), 0.5).alias("mid"), stamps.floor_quantile(C("v"), 1.0).alias("high"))


def fuel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a wind, a gas and a pump station to each type of event but one, as a map told in text."""
    fuel = F.when(C("event_type") == "click", "wind").when(C("event_type") == "purchase", "gas_ccgt").otherwise("pumps")
    w = F.struct(
        (C("value") / 20).alias("wind_speed_100m"), F.when(C("event_id") % 7 != 0, C("value") / 30).alias("wind_speed_10m"), F.when(C("event_id") % 5 != 0, F.lit(990.0)).alias("surface_pressure"),
        F.when(C("event_id") % 3 != 0, C("value") / 10).alias("temperature_2m"), C("value").alias("wind_direction_100m"), F.lit(None).cast("double").alias("relative_humidity_2m"),
        *[F.lit(0.0).alias(n) for n in ("shortwave_radiation", "direct_normal_irradiance", "diffuse_radiation", "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high")],
    )
    m = features.features(fuel, w, F.lit(-30.0), F.lit(140.0), F.timestamp_seconds("at"))
    names = ("wind_power", "wind_speed_100m", "wind_shear", "wind_dir_sin", "wind_dir_cos", "air_density", "temperature_2m", "relative_humidity_2m", "cooling_degrees")
    out = _events(spark, sf_dir).select("event_id", m.alias("m"))
    return out.select("event_id", F.size("m").cast("long").alias("n"), *[F.round(F.try_element_at("m", F.lit(n)), 6).alias(n) for n in names])


def curve_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of nations: one in four failed, one in three without cut-out."""
    key = C("n_nationkey")
    params = F.struct(F.lit(0.0).alias("y_min"), F.lit(1.1).alias("y_max"), F.lit(0.6).alias("k"), (key % 5 + 7.0).alias("v50"), F.lit(None).cast("double").alias("gain"), F.lit(None).cast("double").alias("temp_coeff"))
    fit = F.struct((key % 4 != 0).alias("converged"), F.when(key % 3 != 0, F.lit(22.0)).alias("cut_out"), params.alias("params"))
    curves = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", features.usable_curve(F.lit("wind"), fit).alias("curve"), (key * 10.0).alias("capacity"), F.lit(0.0).alias("x_min"), F.lit(30.0).alias("x_max"))
    return features.sampled(curves, ["n_nationkey"]).select("n_nationkey", C("i").cast("long").alias("i"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def live_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = F.when(C("event_id") % 3 == 0, C("value") > 50)
    return _events(spark, sf_dir).select("event_id", fleet.live_use(F.when(C("event_type") == "view", "suspect").otherwise("ok"), capped).alias("use"))


def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    codes = F.when(C("s_suppkey") % 3 != 0, F.array("s_name")).otherwise(F.array().cast("array<string>"))
    out = fleet.match_rate(s.select(codes.alias("codes"), (C("s_nationkey") != 4).alias("located"), (C("s_acctbal") / 100).alias("capacity")))
    return out.select("stations", "modelled", *[F.round(c, 4).alias(c) for c in ("capacity_mw", "modelled_mw", "percent")])


def band_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.when(C("event_id") % 9 == 0, F.lit(0)).otherwise(C("at")).alias("at"), (C("value") - 80).alias("lo"), (C("value") * 3).alias("hi"))
    return fleet.clipped_history(rows, ["lo", "hi"], F.lit(200.0)).select("event_id", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def coverage_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = _events(spark, sf_dir).groupBy("station").agg((F.count_if(C("value") < 100) / F.count("*")).alias("share"))
    return share.select("station", F.round("share", 6).alias("share"), fleet.coverage_breached(C("share"), 0.85).alias("breached"))


def _skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores (station, fuel, horizon, skill) of users."""
    fuel = F.concat(F.lit("f"), (C("station") % 5).cast("string"))
    return _events(spark, sf_dir).groupBy(C("user_id").alias("station"), fuel.alias("fuel"), C("event_type").alias("horizon")).agg((F.max("value") / 100 - 0.2).alias("skill"))


def skill_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fleet.skill_by_fuel(_skill(spark, sf_dir), TYPES)
    return out.select("fuel", "stations", *[F.round(t, 6).alias(t) for t in TYPES])


def positive_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.always_positive(_skill(spark, sf_dir)).select("stations", "positive", F.round("share", 6).alias("share"))


def interval_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("station", _slot(86_400).alias("at")).agg(F.sum("value").alias("mw"))
    out = fleet.by_interval(rows)
    return out.select("at", "n", F.array_join(F.transform("observations", lambda o: o["station"].cast("string")), ",").alias("stations"), F.round(F.aggregate("observations", F.lit(0.0), lambda a, o: a + o["mw"]), 4).alias("mw"))


def map_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by type as a map of a day, with one of its own kind for days whose number is even."""
    days = _events(spark, sf_dir).groupBy(_slot(86_400).alias("at"), "event_type").agg(F.max("value").alias("v"))
    maps = days.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("demand"))
    extra = days.groupBy("at").agg(F.min("v").alias("value")).where(F.pmod(C("at") / 86_400, F.lit(2)) == 0)
    out = fleet.with_entry(maps, extra, "west")
    return out.select("at", F.size("demand").cast("long").alias("n"), F.try_element_at("demand", F.lit("west")).alias("west"), F.try_element_at("demand", F.lit("view")).alias("view"))


def nearest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings to the price of the interval nearest to them."""
    e = _events(spark, sf_dir)
    price = e.groupBy(_slot().alias("step")).agg(F.max("value").alias("price"))
    return e.withColumn("step", stamps.nearest_step(C("at"))).join(price, "step", "left").select("event_id", "price")


def stack_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    fuels = _events(spark, sf_dir).select(C("event_type").alias("fuel")).distinct()
    return fleet.in_stack_order(fuels, ["view", "click", "refund"]).select("fuel", C("place").cast("long").alias("place"))


def lag_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _events(spark, sf_dir).groupBy("station", (C("event_id") % 13 - 6).alias("lag")).agg((F.avg("value") / 50 - 1).alias("r"))
    return fleet.strongest_first(r, "station").select("station", F.round("strength", 6).alias("strength"), "peak")


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("station", _slot(86_400).alias("at"), C("event_type").alias("horizon"))


def fleet_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = _by_day(spark, sf_dir).agg(F.avg("value").alias("mw"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return fleet.fleet_band(bands, 12).select("at", "horizon", *[F.round(c, 8).alias(c) for c in ("mw", "independent_half", "summed_half")])


def fleet_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("station", _slot(86_400).alias("at")).agg(F.sum("value").alias("mw"), (F.max("value") > 60).alias("usable"))
    return fleet.fleet_scored(rows, 12).select("at", F.round("mw", 4).alias("mw"), "scored")


def expert_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's mix of two experts' three levels."""
    held = _events(spark, sf_dir).groupBy("user_id").agg(F.min("value").alias("a"), F.avg("value").alias("b"), F.max("value").alias("c"))
    parts = held.select("user_id", F.lit(0.25).alias("weight"), F.array("a", "b", "c").alias("quantiles")).union(held.select("user_id", F.lit(0.75), F.array(C("a") * 2, C("b") + 1, C("c") * 3)))
    return fleet.mixed_quantiles(parts, ["user_id"]).select("user_id", *[F.round(C("quantiles")[i], 4).alias(f"q{i}") for i in range(3)])


def feed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    feeds = e.groupBy(C("user_id").alias("feed")).agg(F.when(F.max("value") > 30, F.max("at")).alias("latest"))
    feeds = feeds.select("feed", (C("feed") % 11 == 0).alias("absent"), F.when(C("feed") % 7 == 0, "refused").alias("error"), (C("feed") % 5 == 0).alias("starting"), "latest")
    now = e.agg(F.max("at").alias("now"))  # one row
    return fleet.feed_status(feeds.crossJoin(F.broadcast(now)), C("now")).select("feed", "state", "minutes")


def feed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _events(spark, sf_dir).select(C("event_type").alias("feed"), stamps.day_of(C("at")).alias("day"), F.when(C("event_id") % 2 == 0, 3).otherwise(2).alias("version"), F.lit(12).alias("stations"))
    return fleet.covered(m, 3, 12).select("feed", F.size("days").cast("long").alias("n"), F.try_element_at("days", F.lit(1)).alias("first"), F.try_element_at("days", F.lit(-1)).alias("last"))


def flows_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(_slot(21_600).alias("at"), F.when(C("event_type").isin("view", "click"), "demand").otherwise("flow").alias("kind"), C("event_type").alias("name"), F.when(C("event_id") % 29 == 0, 1).otherwise(0).alias("intervention"), C("value").alias("mw"))
    out = nested.flows_fold(rows)
    return out.select("at", *[F.try_element_at(k, F.lit(n)).alias(n) for k, n in (("demand", "view"), ("demand", "click"), ("flow", "purchase"), ("flow", "signup"))])


def archive_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    rows = e.select(C("user_id").alias("code"), F.timestamp_seconds(_slot(3_600)).alias("at"), (C("value") * 12).alias("mw"))
    codes = e.select(C("user_id").alias("code"), "station", F.when(C("station") > 2, 100.0 * C("station")).alias("capacity")).where("code % 10 <> 0").distinct()
    return nested.archive_fold(rows, codes).select("station", F.unix_timestamp("at").alias("at"), "mw", "facilities", "quality")


def weather_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's readings as hourly arrays of two variables, unpacked again; one in four is missing."""
    held = _events(spark, sf_dir).groupBy(C("user_id").alias("station")).agg(F.array_sort(F.collect_list(F.struct("event_id", "at", F.when(C("event_id") % 4 != 0, C("value")).alias("v")))).alias("a"))
    a = C("a")
    hourly = F.struct(F.transform(a, lambda x: x["at"]).alias("time"), F.transform(a, lambda x: x["v"]).alias("shortwave_radiation"), F.transform(a, lambda x: x["v"] / 2).alias("temperature_2m"))
    return nested.weather(held.select("station", hourly.alias("hourly")), ["shortwave_radiation", "temperature_2m"])


def ramps_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("station", _slot(86_400).alias("at")).agg(F.sum("value").alias("mw"))
    return fleet.ramps_since(rows, F.lit(1_705_276_800)).select("station", "at", F.round("mw", 4).alias("mw"), F.round("ramp", 4).alias("ramp"))


def fleet_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fleet in seconds to prices in milliseconds, which are there for hours with a value over 100."""
    hours = _events(spark, sf_dir).groupBy(_slot(3_600).alias("at")).agg(F.sum("value").alias("mw"), F.max("value").alias("price"))
    return fleet.valued(hours.select("at", "mw"), hours.where("price > 100").select((C("at") * 1000).alias("at_ms"), "price")).select("at", F.round("mw", 4).alias("mw"), "price")


def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations to the region of a fixed map, null for those it leaves out."""
    regions = F.create_map(*[F.lit(x) for pair in (("FRANCE", "W"), ("GERMANY", "W"), ("JAPAN", "E"), ("KENYA", None)) for x in pair])
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.try_element_at(regions, C("n_name")).alias("region"))


QUERIES = {
    f.__name__: f
    for f in (
        safe_names, stamp_clock, map_points, floor_quantiles, fuel_features, curve_samples, live_usability, match_rate, band_history, coverage_breach, skill_pivot, positive_share, interval_groups,
        map_enrich, nearest_price, stack_order, lag_rank, fleet_bands, fleet_scored, expert_mix, feed_states, feed_coverage, flows_fold, archive_fold, weather_unpack, ramps_since, fleet_value, dimension_lookup,
    )
}

_E = "with e as (select event_id, user_id, user_id % 12 as station, cast(floor(epoch(ts)) as bigint) as sec, event_type, value from events)"
_SKILL = _E + ", s as (select user_id as station, 'f' || (station % 5) as fuel, event_type as horizon, max(value) / 100 - 0.2 as skill from e group by 1, 2, 3)"
ORACLE = {
    "safe_names": """with o as (select p_partkey, p_name || ' (*/~+%''!) ä' || p_brand as t from part)
  select p_partkey, replace(replace(replace(replace(url_encode(t), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')') as safe, true as back from o""",
    "stamp_clock": """select event_id, strftime(ts, '%Y-%m-%d') as day, cast(epoch(date_trunc('day', ts)) as bigint) as start, cast(dayofyear(ts) as bigint) as year_day,
  round(hour(ts) * 60 + minute(ts) + second(ts) / 60.0, 4)::double as minutes, strftime(ts + interval 10 hours, '%H:%M') as clock, strftime(ts + interval 10 hours, '%d %b %H:%M') as label,
  strftime(ts - interval 5 minutes, '%Y%m%d%H%M') as before, cast(floor((floor(epoch(ts)) + 150) / 300) as bigint) * 300 as nearest from events""",
    "map_points": "select s_suppkey, round((s_nationkey / 41.0 - 0.5) * 40, 6)::double as x, round(-(s_acctbal / 500 / 34.0 - 0.5) * 40 * 34 / 41, 6)::double as y from supplier",
    "floor_quantiles": "select user_id, v[1 + least(len(v) - 1, floor(0.05 * len(v))::bigint)] as low, v[1 + least(len(v) - 1, floor(0.5 * len(v))::bigint)] as mid, v[len(v)] as high from (select user_id, list_sort(list(value)) as v from events group by 1)",
    "fuel_features": """with w as (select event_id, event_type as k, value / 20 as hi, case when event_id % 7 <> 0 then value / 30 else 0 end as lo, case when event_id % 5 <> 0 then 99000.0 else 101300.0 end as p,
    case when event_id % 3 <> 0 then value / 10 end as t, radians(value) as dir from events), d as (select *, p / (287.05 * (coalesce(t, 15) + 273.15)) as rho from w)
  select event_id, case k when 'click' then 6 when 'purchase' then 3 else 0 end::bigint as n, round(case when k = 'click' then 0.5 * rho * hi * hi * hi / 1000 end, 6) as wind_power, round(case when k = 'click' then hi / 15 end, 6) as wind_speed_100m,
    round(case when k = 'click' then case when hi > 0 and lo > 0 then log10(hi / lo) else 0 end end, 6) as wind_shear, round(case when k = 'click' then sin(dir) end, 6) as wind_dir_sin, round(case when k = 'click' then cos(dir) end, 6) as wind_dir_cos,
    round(case when k = 'click' then rho / 1.225 end, 6) as air_density, round(case when k = 'purchase' then (coalesce(t, 20) - 20) / 20 end, 6) as temperature_2m, case when k = 'purchase' then 0.5::double end as relative_humidity_2m,
    round(case when k = 'purchase' then greatest(0, coalesce(t, 20) - 30) / 20 end, 6) as cooling_degrees from d""",
    "curve_samples": """with p as (select n_nationkey, n_nationkey * 10.0 as cap, n_nationkey % 5 + 7.0 as mid, case when n_nationkey % 3 <> 0 then 22.0 else 1e9 end as cut, i, (30.0::double * i / 159) as x from nation, range(160) t(i) where n_nationkey % 4 <> 0 and n_nationkey > 0)
  select n_nationkey, i, round(x, 6) as x, round(case when x >= cut then 0 else least(cap::double, cap::double * 1.1 / (1 + exp(-0.6 * (x - mid)))) end, 6) as y from p""",
    "live_usability": "select event_id, case when event_type = 'view' or (event_id % 3 = 0 and value > 50) then 'none' when event_id % 3 = 0 then 'fit' else 'score' end as use from events",
    "match_rate": """with s as (select s_acctbal / 100 as mw, s_suppkey % 3 <> 0 and s_nationkey <> 4 and s_acctbal / 100 >= 5 as fits from supplier)
  select count(*) as stations, count(*) filter (fits) as modelled, round(sum(mw), 4) as capacity_mw, round(sum(mw) filter (fits), 4) as modelled_mw, round(100 * sum(mw) filter (fits) / sum(mw), 4) as percent from s""",
    "band_history": "select event_id, round(least(200, greatest(0, value - 80)), 4) as lo, round(least(200, greatest(0, value * 3)), 4) as hi from events where event_id % 9 <> 0",
    "coverage_breach": "with s as (select user_id % 12 as station, avg(case when value < 100 then 1.0 else 0 end) as share from events group by 1) select station, round(share, 6) as share, share < 0.82 or share > 0.88 as breached from s",
    "skill_pivot": _SKILL + " select fuel, count(distinct station) as stations, " + ", ".join(f"round(median(skill) filter (horizon = '{t}'), 6) as {t}" for t in TYPES) + " from s group by fuel",
    "positive_share": _SKILL + ", g as (select station, min(skill) > 0 as good from s group by 1) select count(*) as stations, count(*) filter (good) as positive, round(count(*) filter (good) / count(*), 6) as share from g",
    "interval_groups": _E + " select sec // 86400 * 86400 as at, count(distinct station) as n, string_agg(distinct station::varchar, ',' order by lpad(station::varchar, 2, '0')) as stations, round(sum(value), 4) as mw from e group by 1",
    "map_enrich": _E
    + """, d as (select sec // 86400 as day, event_type, max(value) as v from e group by 1, 2)
  select day * 86400 as at, count(*) + case when day % 2 = 0 then 1 else 0 end as n, case when day % 2 = 0 then min(v) end as west, max(v) filter (event_type = 'view') as view from d group by day""",
    "nearest_price": _E + ", p as (select sec // 300 as k, max(value) as price from e group by 1) select event_id, price from e left join p on k = (sec + 150) // 300",
    "stack_order": "select event_type as fuel, case event_type when 'view' then 1 when 'click' then 2 else 4 end::bigint as place from events group by 1",
    "lag_rank": _E
    + """, r as (select station, event_id % 13 - 6 as lag, avg(value) / 50 - 1 as r from e group by 1, 2), i as (select *, row_number() over (partition by station order by abs(r) desc, lag) as i from r)
  select station, round(abs(r), 6) as strength, lag as peak from i where i = 1""",
    "fleet_bands": _E
    + """, b as (select station, sec // 86400 * 86400 as sec, event_type as horizon, avg(value) as mw, (max(value) - min(value)) / 2 as half from e group by 1, 2, 3)
  select sec as at, horizon, round(sum(mw), 8) as mw, round(sqrt(sum(half * half)), 8) as independent_half, round(sum(half), 8) as summed_half from b group by 1, 2 having count(*) = 12""",
    "fleet_scored": _E
    + ", r as (select station, sec // 86400 * 86400 as sec, sum(value) as mw, max(value) > 60 as usable from e group by 1, 2) select sec as at, round(sum(mw), 4) as mw, count(*) filter (usable) = 12 as scored from r group by 1",
    "expert_mix": """select user_id, round(1.75 * min(value), 4) as q0, round(avg(value) + 0.75, 4) as q1, round(2.5 * max(value), 4) as q2 from events group by 1""",
    "feed_states": _E
    + """, f as (select user_id as feed, case when max(value) > 30 then max(sec) end as latest, (select max(sec) from e) as now from e group by 1), a as (select *, (now - latest + 30) // 60 as minutes from f)
  select feed, case when feed % 11 = 0 then 'absent' when feed % 7 = 0 then 'unreachable' when feed % 5 = 0 then 'starting' when latest is null then 'silent' when minutes > 15 then 'stopped' else 'live' end as state, minutes from a""",
    "feed_coverage": "with m as (select event_type, strftime(ts, '%Y-%m-%d') as day, event_id % 2 = 0 as good from events) select event_type as feed, count(distinct day) filter (good) as n, min(day) filter (good) as first, max(day) filter (good) as last from m group by 1",
    "flows_fold": _E
    + """, r as (select sec // 21600 * 21600 as sec, event_type as k, event_id % 29 = 0 as i, floor(value * 10 + 0.5) / 10 as mw from e), b as (select *, bool_or(i) over (partition by sec) as any_ from r)
  select sec as at, """
    + ", ".join(f"max(mw) filter (k = '{t}' and i = any_) as {t}" for t in TYPES)
    + " from b group by 1",
    "archive_fold": _E
    + """, f as (select station, sec // 3600 * 3600 as sec, floor(sum(value * 12) * 1000 + 0.5) / 1000 as mw, count(*) as facilities from e where user_id % 10 <> 0 group by 1, 2)
  select station, sec as at, mw, facilities, case when station > 2 and mw > 115.0 * station then 'suspect' else 'ok' end as quality from f""",
    "weather_unpack": _E + " select user_id as station, 'shortwave_radiation' as variable, sec - 1800 as at, value from e where event_id % 4 <> 0 union all select user_id, 'temperature_2m', sec, value / 2 from e where event_id % 4 <> 0",
    "ramps_since": _E
    + """, d as (select station, sec // 86400 * 86400 as sec, sum(value) as mw from e group by 1, 2), r as (select *, mw - lag(mw) over (partition by station order by sec) as ramp from d)
  select station, sec as at, round(mw, 4) as mw, round(ramp, 4) as ramp from r where sec > 1705276800""",
    "fleet_value": _E + " select sec // 3600 * 3600 as at, round(sum(value), 4) as mw, case when max(value) > 100 then max(value) end as price from e group by 1",
    "dimension_lookup": "select n_nationkey, case when n_name in ('FRANCE', 'GERMANY') then 'W' when n_name = 'JAPAN' then 'E' end as region from nation",
}
