"""Money, reconciliation, codes, gates and exact ranks over the driver's tables, held to SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import fleet, money
from .aggregates import ORACLE as SHARED

C = F.col
HOUR = 3600


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.withColumns({"station": C("user_id") % 12, "at": F.floor(F.unix_timestamp("ts") / HOUR) * HOUR})


def region_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = money.price_summary(_events(spark, sf_dir).select(C("event_type").alias("region"), (C("value") - 20).alias("rrp")))
    return out.select("region", "count", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p5", "p95", "min", "max")], "negative_intervals", "above_300_intervals", F.round("negative_hours", 6).alias("negative_hours"))


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    observed = e.groupBy("station", "at").agg(F.sum("value").alias("mw")).select("station", (C("station") % 3).alias("region"), C("at").alias("settlement"), "mw")
    prices = e.where(C("at") / HOUR % 7 != 0).groupBy((C("user_id") % 3).alias("region"), C("at").alias("settlement")).agg((F.avg("value") - 45).alias("rrp"), (F.max("value") > 150).alias("apc"))
    return money.station_revenue(observed, prices, 60)


def station_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stations earned at hourly prices of their region, some hours of which have none."""
    return _stations(spark, sf_dir).select("station", "region", *[F.round(c, 4).alias(c) for c in ("total", "energy_mwh", "negative_hours", "negative_revenue", "mean_rrp", "captured_price")], "priced", "unpriced", "administered")


def region_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money.region_revenue(_stations(spark, sf_dir)).select("region", "stations", *[F.round(c, 4).alias(c) for c in ("total", "energy_mwh", "negative_revenue", "negative_hours", "captured_price")], "basis")


def feed_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units' readings against regional sums that are told for the interval before."""
    e = _events(spark, sf_dir).withColumn("region", C("station") % 3)
    units = e.select("region", (C("at") + HOUR).alias("at"), (C("user_id") % 2 == 0).alias("semi"), C("value").alias("mw"))
    sums = e.where("event_id % 10 <> 0").groupBy("region", "at").agg(F.sum("value").alias("generation"), F.sum(F.when(C("user_id") % 2 == 0, C("value"))).alias("semi_cleared"))
    out = money.reconciled(units, sums, HOUR)
    return out.select("region", "at", *[F.round(c, 4).alias(c) for c in ("ours_scheduled", "ours_semi", "theirs_scheduled", "theirs_semi", "diff_pct")], "worst")


def station_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes made of parts' types: a station's name, a unit, and for some the ending of storage."""
    p = _table(spark, sf_dir, "part")
    code = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(C("p_size") % 3 == 0, F.concat(F.lit("_ESR"), C("p_size"))).when(C("p_size") % 3 == 1, F.concat(F.lit("G"), C("p_size"))).otherwise(F.lit("")))
    words = p.select(F.split("p_name", " ").alias("w"))
    ids = words.select(C("w")[0].alias("station")).union(words.select(F.concat_ws("_", C("w")[0], C("w")[1])))
    stations = ids.distinct().withColumn("fuel", F.when(C("station").contains("_") & (F.length("station") % 2 == 0), "battery_charging").otherwise("coal"))
    return money.station_of_code(p.select("p_partkey", code.alias("code")), stations).select("p_partkey", "code", "station")


def skill_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("skill"))
    return scored.select("user_id", "event_type", "n", F.round(money.told_skill(C("n"), C("skill")), 6).alias("skill"))


def stack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly output stacked in the order of the stack, not of names."""
    e = _events(spark, sf_dir)
    places = fleet.in_stack_order(e.select(C("event_type").alias("fuel")).distinct(), ["view", "refund", "click"])
    v = e.groupBy("at", C("event_type").alias("fuel")).agg(F.sum("value").alias("mw")).join(F.broadcast(places), "fuel")  # a row a fuel
    return v.select("at", "fuel", F.round(F.sum("mw").over(Window.partitionBy("at").orderBy("place", "fuel")), 4).alias("top"))


def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count_if(C("value") < 1).alias("n_low"), F.count_if(C("value") > 300).alias("n_high"))
    marks = money.exact_quantiles(e, "event_type", "value", {"median": 0.5, "p5": 0.05, "p95": 0.95}).drop("n")
    return sums.join(marks, "event_type").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p5", "p95")], "lowest", "highest", "n_low", "n_high")


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = money.ranked(_table(spark, sf_dir, "events").select("event_type", "value"), "event_type", [C("value").asc()])
    return found.where(C("rank") == F.floor(C("n") / 2) + 1).select("event_type", C("value").alias("upper_median"))


def _with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money.average_ranks(_with_k(spark, sf_dir), "event_type", "k", "avg_rank").select("event_id", "avg_rank")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = money.average_ranks(money.average_ranks(_with_k(spark, sf_dir), "event_type", "value", "rx"), "event_type", "k", "ry")
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.nullif(F.stddev_pop("rx") * F.stddev_pop("ry"), F.lit(0.0)))
    return both.groupBy("event_type").agg(F.round(F.coalesce(rho, F.lit(0.0)), 6).alias("rho"))


QUERIES = {f.__name__: f for f in (region_prices, station_money, region_money, feed_reconcile, station_prefix, skill_gate, stack_totals, price_summary, upper_median, average_rank, spearman)}

_E = "with e as (select *, user_id % 12 as station, cast(floor(epoch(ts)) as bigint) // 3600 * 3600 as hr from events)"
_STATIONS = _E + """, o as (select station, station % 3 as region, hr, sum(value) as mw from e group by 1, 2, 3),
  p as (select user_id % 3 as region, hr, avg(value) - 45 as rrp, max(value) > 150 as apc from e where hr // 3600 % 7 <> 0 group by 1, 2),
  s as (select station, region, coalesce(sum(mw * rrp), 0) as total, coalesce(sum(mw) filter (rrp is not null), 0) as energy_mwh, count(*) filter (rrp < 0) * 1.0::double as negative_hours,
    coalesce(sum(mw * rrp) filter (rrp < 0), 0) as negative_revenue, avg(rrp) as mean_rrp, count(rrp) as priced, count(*) - count(rrp) as unpriced, count(*) filter (apc) as administered
    from o left join p using (region, hr) group by 1, 2)"""
ORACLE = {
    "region_prices": """with p as (select event_type as region, value - 20 as rrp from events) select region, count(*) as count, round(avg(rrp), 6) as mean, round(quantile_cont(rrp, 0.5), 6) as median, round(quantile_cont(rrp, 0.05), 6) as p5,
  round(quantile_cont(rrp, 0.95), 6) as p95, round(min(rrp), 6) as min, round(max(rrp), 6) as max, count(*) filter (rrp < 0) as negative_intervals, count(*) filter (rrp > 300) as above_300_intervals, round(count(*) filter (rrp < 0) * 5 / 60.0::double, 6) as negative_hours from p group by 1""",
    "station_money": _STATIONS
    + " select station, region, round(total, 4) as total, round(energy_mwh, 4) as energy_mwh, negative_hours, round(negative_revenue, 4) as negative_revenue, round(mean_rrp, 4) as mean_rrp, round(total / nullif(energy_mwh, 0), 4) as captured_price, priced, unpriced, administered from s",
    "region_money": _STATIONS
    + " select region, count(*) as stations, round(sum(total), 4) as total, round(sum(energy_mwh), 4) as energy_mwh, round(sum(negative_revenue), 4) as negative_revenue, max(negative_hours) as negative_hours, round(sum(total) / nullif(sum(energy_mwh), 0), 4) as captured_price, 'spot energy' as basis from s group by 1",
    "feed_reconcile": _E
    + """, o as (select station % 3 as region, hr, coalesce(sum(value) filter (user_id % 2 <> 0), 0) as os, coalesce(sum(value) filter (user_id % 2 = 0), 0) as om from e group by 1, 2),
  t as (select station % 3 as region, hr, sum(value) as g, coalesce(sum(value) filter (user_id % 2 = 0), 0) as m from e where event_id % 10 <> 0 group by 1, 2),
  d as (select t.region, t.hr, os, om, g - m as ts, m as tm, case when g = 0 then 0 else 100 * (os + om - g) / g end as diff from t join o using (region, hr))
  select region, hr as at, round(os, 4) as ours_scheduled, round(om, 4) as ours_semi, round(ts, 4) as theirs_scheduled, round(tm, 4) as theirs_semi, round(diff, 4) as diff_pct,
    row_number() over (partition by hr order by abs(diff) desc, region desc) = 1 as worst from d""",
    "station_prefix": r"""with c as (select p_partkey, replace(p_name, ' ', '_') || case p_size % 3 when 0 then '_ESR' || p_size when 1 then 'G' || p_size else '' end as code from part),
  s as (select distinct split_part(p_name, ' ', 1) as station from part union select distinct split_part(p_name, ' ', 1) || '_' || split_part(p_name, ' ', 2) from part),
  f as (select station, contains(station, '_') and length(station) % 2 = 0 as battery from s),
  m as (select p_partkey, code, station, row_number() over (partition by p_partkey order by length(station) desc nulls last) as i from c left join f
    on starts_with(code, station) and (code = station or regexp_matches(substr(code, length(station) + 1, 1), '[_0-9]')) and (battery or not regexp_matches(code, '_(ESR|BESS)[0-9]*$')))
  select p_partkey, code, station from m where i = 1""",
    "skill_gate": "select user_id, event_type, count(*) as n, case when count(*) >= 50 then round(avg(value), 6) end as skill from events group by 1, 2",
    "stack_totals": _E
    + ", v as (select hr, event_type as fuel, sum(value) as mw from e group by 1, 2) select hr as at, fuel, round(sum(mw) over (partition by hr order by case fuel when 'view' then 1 when 'refund' then 2 when 'click' then 3 else 4 end, fuel), 4) as top from v",
}
ORACLE |= {k: SHARED[k] for k in ("price_summary", "upper_median", "average_rank", "spearman")}
