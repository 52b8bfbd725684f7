"""Fits, signals, neighbours and settlement over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.fits import fit_solar, fit_wind
from ..operators.signals import region_signals, signals


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def solar_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("value").alias("ghi"), F.get_json_object("props", "$.k").cast("double").alias("excess"), (F.col("value") / 500).alias("share"))
    e = e.withColumn("share", F.col("share") + F.col("excess") / 1000)
    return fit_solar(e).select("key", F.round("gain", 5).alias("gain"), F.round("loss", 5).alias("loss"), "n")


def wind_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's response, made with a known curve, fitted again from sums."""
    speed, share = F.col("value") / 10, 1 / (1 + F.exp(-0.6 * (F.col("value") / 10 - 9)))
    e = _events(spark, sf_dir).select(F.ascii("event_type").cast("long").alias("key"), speed.alias("speed"), share.alias("share"))
    out = fit_wind(e)
    return out.select("key", *[F.abs(F.round(c, 4)).alias(c) for c in ("low", "high", "slope", "middle", "rmse")], "n", "converged")


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    b = F.col("s_acctbal")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("station"), F.col("n_regionkey").alias("region"), F.lit(10000.0).alias("capacity"), b.alias("mw"), F.lit(2000.0).alias("reference"),
        (b - 1500).alias("lo"), (b + 1500).alias("hi"), F.lit(0.5).alias("hours"), F.lit(20.0).alias("price"),
        F.when(b < 0, None).otherwise(b / 10000).alias("skill"), (F.pmod("s_suppkey", F.lit(4)) / 4.0).alias("masked"),
    )


def signals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(_forecasts(spark, sf_dir)).select("station", "region", F.round("expected_dollars", 4).alias("expected_dollars"), F.round("confidence", 6).alias("confidence"), "label", "action", "constrained", "rationale")


def region_signals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = region_signals(signals(_forecasts(spark, sf_dir)))
    return out.select("region", *[F.round(c, 4).alias(c) for c in ("mw", "reference", "lo", "hi", "expected_dollars", "skill")], "constrained")


def settle_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional hourly rows give way to settled ones of the same day, whole days at a time."""
    hourly = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("hour")).agg(F.sum("value").alias("mw"))
    live = hourly.withColumn("settled", F.lit(False))
    final = hourly.where("day < '2024-01-15'").select("day", "hour", (F.col("mw") * 1.01).alias("mw"), F.lit(True).alias("settled"))
    rows = live.unionByName(final).withColumn("best", F.max("settled").over(Window.partitionBy("day")))
    return rows.where("settled = best").select("day", "hour", F.round("mw", 4).alias("mw"), "settled")


QUERIES = {"solar_fit": solar_fit, "wind_fit": wind_fit, "signals": signals_query, "region_signals": region_signals_query, "settle_upsert": settle_upsert}

_SIGNALS = """select *, (mw - 2000) * 0.5 * 20 as d, case when mw < 0 then 0 else least(1, mw / 10000 / 0.5) end * least(1, greatest(0, 1 - 3000 / 10000.0)) * (1 - masked) as conf from (
  select s_suppkey as station, n_regionkey as region, s_acctbal as mw, (s_suppkey % 4) / 4.0 as masked from supplier join nation on s_nationkey = n_nationkey) t"""

ORACLE = {
    "solar_fit": """select key, round((ay * bb - by_ * ab) / det, 5) as gain, round(-(by_ * aa - ay * ab) / det, 5) as loss, n from (select *, aa * bb - ab * ab as det from (
        select user_id as key, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as by_, count(*) as n from (
        select user_id, value / 1000 as a, value / 1000 * k as b, value / 500 + k / 1000 as y from (select user_id, value, cast(json_extract_string(props, '$.k') as double) as k from events) x) z group by user_id) s) d""",
    "signals": f"""select station, region, round(d, 4) as expected_dollars, round(conf, 6) as confidence, case when 3000 > abs(mw) then 'low' when conf >= 0.6 then 'high' when conf >= 0.3 then 'medium' else 'low' end as label, action, masked > 0.5 as constrained,
        action || ': ' || cast(floor(mw) as bigint) || ' MW against 2000 MW, ' || case when masked > 0.5 then 'constrained' else 'free' end as rationale from (
        select *, case when mw <= 0 then 'watch' when 2000 between mw - 1500 and mw + 1500 then 'hold' when abs(d) < 1000 then 'hold' when d > 0 then 'opportunity' else 'risk' end as action from ({_SIGNALS}) a) b""",
    "region_signals": f"""select region, round(sum(mw), 4) as mw, round(sum(2000.0), 4)::double as reference, round(sum(mw - 1500), 4) as lo, round(sum(mw + 1500), 4) as hi, round(sum(d), 4) as expected_dollars,
        round(sum(case when mw >= 0 then mw / 10000 * 10000 end) / sum(case when mw >= 0 then 10000 end), 4) as skill, sum(case when masked > 0.5 then 10000 else 0 end) > 0.5 * sum(10000) as constrained from ({_SIGNALS}) a group by region""",
    "wind_fit": "select cast(ascii(event_type) as bigint) as key, 0.0::double as low, 1.0::double as high, 0.6::double as slope, 9.0::double as middle, 0.0::double as rmse, count(*) as n, true as converged from events group by 1",
    "settle_upsert": """select cast(ts as date) as day, cast(hour(ts) as bigint) as hour, round(sum(value) * case when cast(ts as date) < date '2024-01-15' then 1.01::double else 1 end, 4) as mw, cast(ts as date) < date '2024-01-15' as settled from events group by 1, 2""",
}
