"""Reports written and scanned, and tables with versions that streams fill, over the driver's events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import days, feeds, report

C = F.col
#: Files that a stream's rows are dealt over, a micro-batch each: intervals and days are split over all of them.
BATCHES = 3


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _write_reports(tables: dict[str, tuple[list[str], DataFrame]], path: str) -> None:
    """Reports from tables {name: (columns, rows with `file` and `place`)}: a file each, its lines in order, with heading and footer."""

    def quoted(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    lines = None
    for k, (name, (columns, rows)) in enumerate(tables.items()):
        key = [F.lit("D"), *(F.lit(p) for p in name.split(".")), F.lit("1")]
        data = rows.select("file", F.lit(2 * k + 2).alias("block"), C("place"), F.concat_ws(",", *key, *(quoted(C(c)) for c in columns)).alias("line"))
        head = rows.select("file").distinct().select("file", F.lit(2 * k + 1), F.lit(0), F.lit(",".join(["I", *name.split("."), "1", *columns])))
        lines = data.union(head) if lines is None else lines.union(data).union(head)
    start = lines.select("file").distinct().select("file", F.lit(0), F.lit(0), F.lit("C,SETP.WORLD,REPORT"))
    end = lines.groupBy("file").agg(F.lit(99), F.lit(0), F.concat(F.lit(f'C,"{report.FOOTER}",'), (F.count("*") + 2).cast("string")))
    lines = lines.union(start).union(end)
    lines.repartition("file").sortWithinPartitions("file", "block", "place").select("file", "line").write.partitionBy("file").text(path)


def report_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings and daily peaks written as nested reports, and both tables scanned, the columns that are asked for typed."""
    e, path = _events(spark, sf_dir), _folder(spark, "reports")
    readings = e.select((C("user_id") % 16).alias("file"), C("event_id").alias("place"), C("event_id").alias("EVENT"), F.concat("event_type", F.lit(', "raw"')).alias("KIND"), F.date_format("ts", "yyyy/MM/dd").alias("DAY"), C("value").alias("MW"))
    peaks = e.groupBy((C("user_id") % 16).alias("file"), F.date_format("ts", "yyyy/MM/dd").alias("DAY")).agg(F.max("value").alias("PEAK")).withColumn("place", F.replace("DAY", F.lit("/"), F.lit("")).cast("long"))
    _write_reports({"DISPATCH.READING": (["EVENT", "KIND", "DAY", "MW"], readings), "DISPATCH.PEAK": (["DAY", "PEAK"], peaks)}, path)
    units = report.read_reports(spark, path, ["DISPATCH.READING"], schema="KIND string, MW double")
    units = units.groupBy(F.lit("DISPATCH.READING").alias("report"), C("KIND").alias("key")).agg(F.count("MW").alias("n"), F.round(F.sum("MW"), 4).alias("total"))
    cells = report.read_reports(spark, path).where("report = 'DISPATCH.PEAK'")
    days_ = cells.groupBy("report", F.try_element_at("cells", F.lit("DAY")).alias("key")).agg(F.count("*").alias("n"), F.round(F.sum(F.try_element_at("cells", F.lit("PEAK")).cast("double")), 4).alias("total"))
    return units.unionByName(days_)


def _arriving(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A stream of rows that come in BATCHES micro-batches, whatever key or day they are of, and a place for its table."""
    spark, path = rows.sparkSession, _folder(rows.sparkSession, name)
    for k in range(BATCHES):
        rows.where(C("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(f"{path}-in")
    return spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}-in"), path


def interval_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals filled by several micro-batches: every reading stays, and a key's later version wins, in whatever batch it came."""
    e = _events(spark, sf_dir).select((F.floor(F.unix_timestamp("ts") / 86_400) * 86_400).alias("at"), C("user_id").alias("station"), C("event_id").alias("version"), C("value").alias("mw"), (C("event_id") % BATCHES).alias("batch"))
    rows, path = _arriving(e, "intervals")
    feeds.write_intervals(rows, path, f"{path}-state", ["station"], "version").awaitTermination()
    held = feeds.interval_table(spark, path, rows.schema, ["station"], "version").read()
    return held.groupBy("at").agg(F.count("*").alias("stations"), F.round(F.sum("mw"), 4).alias("mw"), F.max("version").alias("newest"))


def settled_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of provisional and settled hours that come mixed over several micro-batches: settled days hold all their settled rows and no other."""
    hours = _events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("mw"))
    live = hours.select("day", "hour", "mw", F.lit(False).alias("settled"))
    final = hours.where("day < '2024-01-15'").select("day", "hour", (C("mw") * 1.01).alias("mw"), F.lit(True))
    rows = live.union(final).withColumns({"at": C("hour"), "batch": F.when(C("settled"), (C("hour") + 1) % BATCHES).otherwise(C("hour") % BATCHES)})
    stream, path = _arriving(rows, "settled")
    days.settle(stream, path, f"{path}-state", ["hour"]).awaitTermination()
    return days.settled_table(spark, path, stream.schema, ["hour"]).read().select("day", C("hour").cast("long").alias("hour"), F.round("mw", 4).alias("mw"), "settled")


QUERIES = {f.__name__: f for f in (report_scan, interval_versions, settled_versions)}

ORACLE = {
    "report_scan": """select 'DISPATCH.READING' as report, event_type || ', "raw"' as key, count(value) as n, round(sum(value), 4) as total from events group by 2
  union all select 'DISPATCH.PEAK', day, count(*), round(sum(peak), 4) from (select user_id % 16 as f, strftime(ts, '%Y/%m/%d') as day, max(value) as peak from events group by 1, 2) group by 2""",
    "interval_versions": """with e as (select cast(floor(epoch(ts)) as bigint) // 86400 * 86400 as d, user_id, event_id, value from events), l as (select * from e qualify row_number() over (partition by d, user_id order by event_id desc) = 1)
  select d as at, count(*) as stations, round(sum(value), 4) as mw, max(event_id) as newest from l group by 1""",
    "settled_versions": """select strftime(ts, '%Y-%m-%d') as day, cast(hour(ts) as bigint) as hour, round(sum(value) * case when cast(ts as date) < date '2024-01-15' then 1.01::double else 1 end, 4) as mw, cast(ts as date) < date '2024-01-15' as settled
  from events group by 1, 2, 4, cast(ts as date) < date '2024-01-15', cast(ts as date)""",
}
