"""Ordered recurrences over hot keys: climatology by cell, ranks; over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import climatology
from ..operators.prefix import rank_in_group

C = F.col
#: Half days: at the driver's sizes most cells then hold more readings than the floor of the rate lets count alike.
BUCKET = 720


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C("event_type").alias("station"), F.unix_timestamp("ts").alias("at"), "value")


def climatology_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each event type by month and half day, and by half day alone, learned one reading after another."""
    out = climatology.cells(_readings(spark, sf_dir), BUCKET)
    return out.select("station", C("month").cast("long").alias("month"), "bucket", F.round("mean", 6).alias("mean"), "n")


def climatology_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to expect of each event type at some hours of three months, most of which have no cell of their own."""
    known = climatology.cells(_readings(spark, sf_dir), BUCKET)
    hours = spark.range(0, 90).select((F.lit(1_704_067_200) + C("id") * 86_400 + C("id") % 24 * 3600).alias("at"))
    types = _readings(spark, sf_dir).groupBy("station").agg(F.max("value").alias("capacity"))
    targets = types.select("station", F.lit(7.0).alias("last"), (C("capacity") / 10).alias("capacity")).join(hours)
    return climatology.expected(targets, known, BUCKET).select("station", "at", F.round("expected", 6).alias("expected"))


def reading_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each reading among those of its type by value, ties by id: a type is split over tasks."""
    return rank_in_group(_readings(spark, sf_dir), C("station"), [C("value").asc(), C("event_id").asc()]).select("event_id", "rank")


QUERIES = {f.__name__: f for f in (climatology_cells, climatology_expected, reading_rank)}

# The recurrence in closed form: after 500 readings the weight of each falls by 499/500 with every later one.
_CELLS = """with e as (select event_type as station, month(ts) as m, (hour(ts) * 60 + minute(ts)) // 720 as bucket, cast(floor(epoch(ts)) as bigint) as sec, value from events),
  two as (select station, m as month, bucket, sec, value from e union all select station, null, bucket, sec, value from e),
  r as (select *, row_number() over (partition by station, month, bucket order by sec, value) as i, count(*) over (partition by station, month, bucket) as n from two),
  cells as (select station, cast(month as bigint) as month, cast(bucket as bigint) as bucket, sum(value * case when n <= 500 then 1.0::double / n else pow(0.998::double, n - greatest(i, 500)) / 500 end) as mean, max(n) as n from r group by 1, 2, 3)"""
ORACLE = {
    "climatology_cells": _CELLS + " select station, month, bucket, round(mean, 6) as mean, n from cells",
    "climatology_expected": _CELLS
    + """, h as (select 1704067200 + i * 86400 + i % 24 * 3600 as sec from range(90) t(i)), k as (select event_type as station, max(value) / 10 as capacity from events group by 1),
  t as (select station, cast(sec as bigint) as sec, capacity, month(make_timestamp(sec * 1000000)) as m, (sec // 60 % 1440) // 720 as b from k, h)
  select t.station, t.sec as at, round(greatest(0, least(coalesce(own.mean, backstop.mean, 7.0), capacity)), 6)::double as expected from t
  left join cells own on own.station = t.station and own.month = m and own.bucket = b left join cells backstop on backstop.station = t.station and backstop.month is null and backstop.bucket = b""",
    "reading_rank": "select event_id, row_number() over (partition by event_type order by value, event_id) as rank from events",
}
