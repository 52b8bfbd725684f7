"""Streams with state bounded by event time over the driver's events: outcomes, fleet instants, feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import outcomes
from ..streaming.windows import gathered

C = F.col
#: Micro-batches of a stream, in order of time, and how many rows a file of them has about.
SLICES, ROWS_A_FILE = 3, 1 << 18
HOUR, DAY = 3600, 86_400


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("sec", F.unix_timestamp("ts"))


def _stream(rows: DataFrame, at: str, name: str, a_file: int = ROWS_A_FILE) -> DataFrame:
    """Rows as a stream that comes in SLICES micro-batches, cut at equal widths of a time in seconds; a micro-batch is as many files as its rows need."""
    spark, path = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}-whole")  # made once, cut after
    whole = spark.read.schema(rows.schema).parquet(f"{path}-whole")
    ends = whole.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()  # one row
    lo, width = ends.lo or 0, max(1, -(-((ends.hi or 0) - (ends.lo or 0) + 1) // SLICES))
    counts = whole.groupBy(F.floor((C(at) - lo) / width).alias("k")).agg(F.count("*").alias("n")).collect()  # a row a micro-batch
    files = max([1, *(-(-r.n // a_file) for r in counts if r.k is not None)])
    for k in range(SLICES):
        part = whole.where(F.floor((C(at) - lo) / width) == k)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.parquet(f"{path}/{k}")
        # all micro-batches have the same number of files, as the reader takes that many at a time
        for more in range(files - len(spark.read.schema(rows.schema).parquet(f"{path}/{k}").inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{path}/{k}-{more}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


def forecast_outcome_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading as a forecast for the hour a day later, joined to that hour's mean as both streams arrive; forecasts whose hour
    passed without a usable mean have no error."""
    e = _events(spark, sf_dir).withColumn("hour", F.floor(C("sec") / HOUR) * HOUR)
    f = e.select("event_id", C("user_id").alias("key"), "value", F.timestamp_seconds(C("hour") + DAY).alias("due"), "sec")
    o = e.groupBy(C("user_id").alias("key"), "hour").agg(F.avg(F.when(C("value") <= 400, C("value"))).alias("actual")).select("key", F.timestamp_seconds("hour").alias("at"), "actual", C("actual").isNotNull().alias("usable"), "hour")
    out = outcomes.scored(_stream(f, "sec", "forecasts").drop("sec"), _stream(o, "hour", "outcomes").drop("hour"), "2 hours")
    return gathered(out, "append").select("event_id", C("key").alias("user_id"), F.round(F.abs(C("value") - C("actual")), 6).alias("error"))


def fleet_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's daily output as its stations' readings come in, repeats included."""
    e = _events(spark, sf_dir).withColumns({"station": C("user_id") % 12, "day": F.floor(C("sec") / DAY) * DAY})
    rows = e.groupBy("station", "day").agg(F.sum("value").alias("mw"), (F.max("value") > 60).alias("usable"))
    rows = rows.unionByName(rows.where("station = 3")).select(C("station").cast("long").alias("station"), F.timestamp_seconds("day").alias("at"), "mw", "usable", "day")
    out = outcomes.fleet_instants(_stream(rows, "day", "readings").drop("day"), 12, "1 day")
    return gathered(out, "append").select(F.unix_timestamp("at").alias("at"), F.round("mw", 4).alias("mw"), "complete", "scored")


def unseen_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly intervals of a feed per event type, listed again and again: each once, oldest first, those without a value left out."""
    e = _events(spark, sf_dir).withColumn("at", F.floor(C("sec") / HOUR) * HOUR)
    hours = e.groupBy(C("event_type").alias("feed"), "at").agg(F.max("event_id").alias("k"), F.max("value").alias("value"))
    rows = hours.select("feed", F.timestamp_seconds("at").alias("ts"), "at", F.when(C("k") % 5 != 0, C("value")).alias("value"), F.lit(None).cast("array<long>").alias("listed"))
    out = outcomes.unseen(_stream(rows.unionByName(rows), "at", "feeds"), "2 hours")
    return gathered(out, "append").select("feed", "at", F.round("value", 6).alias("value"), "place")


def _run(query):
    """A query whose streams use timers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(key)
        outcomes.with_timers(spark)
        try:
            return query(spark, sf_dir)
        finally:
            spark.conf.set(key, before)

    return run


QUERIES = {"forecast_outcome_stream": forecast_outcome_stream, "fleet_instants": _run(fleet_instants), "unseen_intervals": _run(unseen_intervals)}

# Rows without their counterpart come out once the watermark, the greatest time less the lateness, has reached them.
_E = "with e as (select event_id, user_id, event_type, value, cast(floor(epoch(ts)) as bigint) as sec from events)"
ORACLE = {
    "forecast_outcome_stream": _E
    + """, f as (select event_id, user_id, value, sec // 3600 * 3600 + 86400 as due from e), h as (select user_id, sec // 3600 * 3600 as hr, avg(value) filter (value <= 400) as actual from e group by 1, 2)
  select event_id, f.user_id, round(abs(value - actual), 6) as error from f left join h on h.user_id = f.user_id and h.hr = due and actual is not null
  where actual is not null or due <= (select max(hr) from h where actual is not null) - 7200""",
    "fleet_instants": _E
    + """, r as (select user_id % 12 as station, sec // 86400 * 86400 as d, sum(value) as mw, max(value) > 60 as usable from e group by 1, 2)
  select d as at, round(sum(mw), 4) as mw, count(*) = 12 as complete, count(*) filter (usable) = 12 as scored from r group by 1 having count(*) = 12 or d <= (select max(d) from r) - 86400""",
    "unseen_intervals": _E
    + """, h as (select event_type as feed, sec // 3600 * 3600 as hr, max(event_id) as k, max(value) as value from e group by 1, 2)
  select feed, hr as at, round(value, 6) as value, row_number() over (partition by feed order by hr) as place from h where k % 5 <> 0 and hr <= (select max(hr) from h) - 7200""",
}
