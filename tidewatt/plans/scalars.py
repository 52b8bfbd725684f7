"""Scalar libraries, the time axis and windowed streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics, scores, text
from ..operators.timeaxis import as_of, interpolated, lagged_correlation
from ..streaming.windows import settled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean value of each event type, by hour number."""
    e = _table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("step")).agg(F.avg("value").alias("v"), F.count("*").cast("double").alias("n"))


_STEPS = "select event_type, cast(floor(epoch(ts) / 3600) as bigint) as step, avg(value) as v, cast(count(*) as double) as n from events group by 1, 2"


def physics_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    density = physics.air_density(100000 + v * 10, v / 20)
    return _table(spark, sf_dir, "events").select(
        "event_id", F.round(density, 6).alias("density"), F.round(physics.wind_power(density, v / 20), 4).alias("power"),
        F.round(physics.wind_shear(v / 20, v / 40 + 1), 6).alias("shear"), F.round(physics.wind_fraction(v / 20), 6).alias("wind"),
        F.round(physics.solar_fraction(v / 500, v * 2, v / 20), 6).alias("solar"), F.round(physics.symlog(v - 50), 6).alias("symlog"),
        F.round(physics.huber(v / 997), 6).alias("huber"), physics.round3(v / 7).alias("mw"),
    )


def solar_zenith(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = physics.solar_zenith(F.lit(-33.9), F.lit(151.2), F.col("ts"))
    return _table(spark, sf_dir, "events").select("event_id", F.round(z, 6).alias("zenith"), F.round(physics.clear_sky_ghi(F.cos(z)), 4).alias("clear_sky"))


def crps_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    q = F.array(*[F.struct(F.lit(p).alias("q"), F.lit(x).alias("v")) for p, x in ((0.1, 10.0), (0.5, 50.0), (0.9, 120.0))])
    return _table(spark, sf_dir, "events").select("event_id", F.round(scores.crps(q, v), 6).alias("crps"), F.round(scores.pit(q, v), 6).alias("pit"))


def crps_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _table(spark, sf_dir, "events").select("event_id", F.round(scores.crps_of_samples(F.array(v * 0.5, v + 10, F.lit(40.0)), v), 6).alias("crps"))


def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", text.normal_name(n, ["POWER", "STATION"]).alias("name"), text.without_unit_number(n).alias("stem"))


def token_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text.contains_run(F.split("p_type", " "), F.slice(F.split("p_type", " "), 2, 1)).alias("has_run"), text.prefix_match(F.col("p_brand"), F.lit("Brand#1")).alias("of_brand"))


def asof_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    grid = e.where("event_type = 'view'").select("user_id", "event_id")
    samples = e.where("event_type = 'click'").select("user_id", "event_id", "value")
    return as_of(grid, samples, "user_id", "event_id", "value")


def bracket_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    grid = e.where("event_type = 'view'").select("user_id", "event_id")
    samples = e.where("event_type = 'click'").select("user_id", "event_id", "value")
    return interpolated(grid, samples, "user_id", "event_id", "value").withColumn("value", F.round("value", 6))


def lag_cross_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lagged_correlation(_steps(spark, sf_dir), "event_type", "step", "v", "n", 12).select("event_type", "lag", "n", F.round("r", 6).alias("r"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, f"{sf_dir}/events.parquet", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, f"{sf_dir}/events.parquet", "2 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (physics_features, solar_zenith, crps_quantile, crps_ensemble, name_normalise, token_run, asof_last, bracket_interpolate, lag_cross_corr, stream_tumbling, stream_sliding)}

ORACLE = {
    "physics_features": """select event_id, round(d, 6) as density, round(d * pow(value / 20, 3) * 0.5, 4) as power, round(case when value > 0 then log10((value / 20) / (value / 40 + 1)) else 0 end, 6) as shear,
        round(case when value / 20 < 3 or value / 20 >= 25 then 0 else 0.98 / (1 + exp(-0.62 * (value / 20 - 9.5))) end, 6) as wind,
        round(0.95 * (value / 500 * value * 2 / 1000) * (1 - 0.004 * greatest(0, value / 20 + value / 500 * value * 2 / 40 - 25)), 6) as solar,
        round(case when abs(value - 50) <= 10 then (value - 50) / 10 else sign(value - 50) * (1 + log10(abs(value - 50) / 10)) end, 6) as symlog,
        round(case when value / 997 <= 0.08 then value / 997 * value / 997 * 0.5 else 0.08 * (value / 997 - 0.04) end, 6) as huber, floor(value / 7 * 1000 + 0.5) / 1000 as mw
        from (select *, (100000 + value * 10) / (287.05 * (value / 20 + 273.15)) as d from events) t""",
    "solar_zenith": """select event_id, round(z, 6) as zenith, round(case when cos(z) <= 0 then 0 else 1098.0 * cos(z) * exp(-0.057 / cos(z)) end, 4) as clear_sky from (
        select event_id, acos(least(1, greatest(-1, sin(radians(-33.9)) * sin(decl) + cos(radians(-33.9)) * cos(decl) * cos(radians((m + eq + 4 * 151.2) / 4 - 180))))) as z from (
        select event_id, m, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) as eq,
        0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) as decl from (
        select event_id, m, 2 * pi() / 365 * (dayofyear(ts) - 1 + (m / 60 - 12) / 24) as g from (select event_id, ts, hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60 as m from events) a) b) c) d""",
    "crps_quantile": """with p as (select event_id, value as v, case when value >= 10 then 0.1 * (value - 10) else 0.9 * (10 - value) end as a, case when value >= 50 then 0.5 * (value - 50) else 0.5 * (50 - value) end as b,
        case when value >= 120 then 0.9 * (value - 120) else 0.1 * (120 - value) end as c from events)
        select event_id, round(2 * (a + b + c) / 3, 6) as crps, round(case when v < 10 then 0.05 when v > 120 then 0.95 when v < 50 then 0.1 + 0.4 * (v - 10) / 40 else 0.5 + 0.4 * (v - 50) / 70 end, 6) as pit from p""",
    "crps_ensemble": """select event_id, round((abs(a - v) + abs(b - v) + abs(c - v)) / 3 - (abs(a - b) + abs(a - c) + abs(b - c)) / 9, 6) as crps from (select event_id, value as v, value * 0.5 as a, value + 10 as b, 40.0::double as c from events) t""",
    "name_normalise": """select p_partkey, regexp_replace(regexp_replace(split_part(upper(p_name), '&', 1), '\\b(POWER|STATION)\\b', '', 'g'), '[^A-Z0-9]', '', 'g') as name, regexp_replace(p_name, '[_#-]?\\d+$', '') as stem from part""",
    "token_run": """select p_partkey, len(string_split(p_type, ' ')) > 1 as has_run, p_brand = 'Brand#1' or regexp_matches(p_brand, '^Brand#1[_0-9]') as of_brand from part""",
    "asof_last": """select g.user_id, g.event_id, s.value from (select user_id, event_id from events where event_type = 'view') g
        asof left join (select user_id, event_id, value from events where event_type = 'click') s on s.user_id = g.user_id and g.event_id >= s.event_id""",
    "bracket_interpolate": """select g.user_id, g.event_id, round(a.value + (b.value - a.value) * (g.event_id - a.event_id) / (b.event_id - a.event_id), 6) as value from (select user_id, event_id from events where event_type = 'view') g
        asof left join (select user_id, event_id, value from events where event_type = 'click') a on a.user_id = g.user_id and g.event_id >= a.event_id
        asof left join (select user_id, event_id, value from events where event_type = 'click') b on b.user_id = g.user_id and g.event_id <= b.event_id""",
    "lag_cross_corr": f"""with s as ({_STEPS}), l as (select unnest(range(-12, 13)) as lag)
        select x.event_type, cast(l.lag as integer) as lag, count(*) as n, round(case when count(*) < 3 then 0 else coalesce(covar_pop(x.v, y.n) / nullif(stddev_pop(x.v) * stddev_pop(y.n), 0), 0) end, 6) as r
        from s x, l, s y where y.event_type = x.event_type and y.step = x.step + l.lag group by 1, 2""",
    "stream_tumbling": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
    "stream_sliding": "select start, event_type, count(*) as n, round(sum(value), 4) as value from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start, event_type, value from events) t group by 1, 2",
}
