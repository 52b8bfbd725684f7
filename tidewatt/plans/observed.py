"""Observation folds over the driver's tables, with SQL for DuckDB written apart.

Surrogates: users are units of the station of their id modulo 12, events their readings at five-minute stamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import observations as o


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.timestamp_seconds((F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 300) * 300).cast("long"))
    return events.select("event_id", F.col("user_id").alias("unit"), stamp.alias("at"), F.when(F.col("value") < 400, F.col("value")).alias("mw"), "event_type")


def _units(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("unit") % 5 == 0, "LOAD").otherwise("GENERATOR")
    schedule = F.when(F.col("unit") % 3 == 0, "SEMI-SCHEDULED").otherwise("SCHEDULED")
    return rows.select("unit").distinct().select("unit", (F.col("unit") % 12).alias("station"), kind.alias("dispatch_type"), schedule.alias("schedule_type"))


def _solution(rows: DataFrame) -> DataFrame:
    return rows.select(
        "unit", "at", (F.col("mw") + 10).alias("availability"), F.when(F.col("event_type") != "view", F.col("mw") + 5).alias("uigf"),
        (F.col("mw") * 0.75).alias("cleared"), (F.col("mw") > 100).alias("capped"),
    )


def _plain(df: DataFrame, *numbers: str) -> DataFrame:
    return df.select("station", F.unix_timestamp("at").alias("slot"), *[F.round(c, 4).alias(c) for c in numbers], *[c for c in df.columns if c not in ("station", "at", *numbers)])


def obs_output_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir)
    return _plain(o.output_fold(rows, _units(rows)), "output_mw")


def obs_solution_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir)
    return _plain(o.solution_fold(_solution(rows), _units(rows)), "availability_mw", "uigf_mw", "cleared_semi_mw", "curtailed_mw")


def obs_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir)
    units = _units(rows)
    stations = units.select("station").distinct().select("station", (F.lit(80.0) + 5 * F.col("station")).alias("capacity"), (F.col("station") % 4 == 0).alias("battery"))
    seen = o.assemble(o.output_fold(rows, units), o.solution_fold(_solution(rows), units), o.expected_units(rows, units), stations)
    return seen.select("station", F.unix_timestamp("at").alias("slot"), "quality", "expected")


QUERIES = {f.__name__: f for f in (obs_output_fold, obs_solution_fold, obs_assembled)}

_BASE = """with r as (
  select user_id as unit, user_id % 12 as station, cast(floor(epoch(ts) / 300) as bigint) * 300 as slot, case when value < 400 then value end as mw, event_type,
    user_id % 5 = 0 as is_load, user_id % 3 = 0 as is_semi from events),
out as (
  select station, slot - 300 as slot, sum(case when is_load then -mw else mw end) as output_mw, count(*) filter (abs(mw) > 1) as online,
    count(distinct unit) filter (mw is not null) as units from r group by station, r.slot - 300),
sol as (
  select station, slot, sum(mw + 10) filter (not is_load) as availability_mw, sum(mw + 5) filter (is_semi and event_type <> 'view') as uigf_mw,
    sum(mw * 0.75) filter (is_semi) as cleared_semi_mw, bool_or(mw > 100) as capped from r group by station, slot)
"""
ORACLE = {
    "obs_output_fold": _BASE + "select station, slot, round(output_mw, 4) as output_mw, online, units from out",
    "obs_solution_fold": _BASE
    + """select station, slot, round(availability_mw, 4) as availability_mw, round(uigf_mw, 4) as uigf_mw, round(cleared_semi_mw, 4) as cleared_semi_mw,
  round(case when uigf_mw is not null then greatest(0, uigf_mw - coalesce(cleared_semi_mw, 0)) end, 4) as curtailed_mw, capped from sol""",
    "obs_assembled": _BASE
    + """, want as (select station, count(distinct unit) as expected from r where mw is not null group by station),
  both_ as (select coalesce(o.station, s.station) as station, coalesce(o.slot, s.slot) as slot, output_mw, units from out o full join sol s on o.station = s.station and o.slot = s.slot),
  ramped as (select b.*, p.output_mw as before from both_ b left join both_ p on p.station = b.station and p.slot = b.slot - 300)
  select station, slot, case when abs(output_mw) > 1.15 * (80 + 5 * station) or abs(output_mw - before) > (80 + 5 * station) * (case when station % 4 = 0 then 2 else 1 end) then 'suspect'
    when output_mw is not null and units < expected then 'partial' else 'ok' end as quality, expected from ramped left join want using (station)""",
}
