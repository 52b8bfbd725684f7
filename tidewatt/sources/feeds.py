"""Feeds kept as tables with versions, by interval: written by a stream, listed by a manifest, swept by age; summaries written out of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.money import exact_quantiles
from .versions import VersionedTable, latest_by

HOUR = 3600
#: A feed keeps so many hours, and a cold start reads back so many at most.
KEPT_HOURS = 36
BRIDGE_HOURS = 24


def interval_table(spark: SparkSession, path: str, schema: StructType | str, keys: list[str], newest: str = "at") -> VersionedTable:
    """A table by interval of rows with `at` (seconds) and keys. Of rows of one key and interval the one of greatest `newest` stays, then
    the greatest, so the order in which they come doesn't count."""
    return VersionedTable(spark, path, schema, "at", latest_by(["at", *keys], newest))


def write_intervals(stream: DataFrame, path: str, checkpoint: str, keys: list[str], newest: str = "at"):
    """Starts a stream of rows with `at` (seconds) into an `interval_table` and returns the query. An interval may come over any
    number of micro-batches; one that is run again changes nothing, and readers see whole commits."""

    def put(batch: DataFrame, number: int) -> None:
        interval_table(batch.sparkSession, path, stream.schema, keys, newest).merge(batch, checkpoint, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(spark: SparkSession, feeds: dict[str, tuple[str, int]]) -> DataFrame:
    """Rows (feed, cadence, intervals, latest) of feeds given as {feed: (path, cadence in seconds)}, as of their latest commits, so it
    is never ahead of the rows; an empty feed has no latest."""
    rows = []
    for feed, (path, cadence) in feeds.items():
        held = sorted(int(p) for p in VersionedTable(spark, path, StructType(), "at").parts())
        rows.append((feed, cadence, held, held[-1] if held else None))
    return spark.createDataFrame(rows, "feed string, cadence long, intervals array<long>, latest long")


def sweep(spark: SparkSession, path: str, now: int, hours: float = KEPT_HOURS) -> int:
    """Leaves out the intervals older than `hours`; one exactly that old stays. Returns how many went."""
    return VersionedTable(spark, path, StructType(), "at").drop(lambda at: int(at) < now - hours * HOUR)


def bridge_start(last_settled: int | None, now: int, hours: float = BRIDGE_HOURS) -> int:
    """Where a cold start begins to read: after what is settled, `hours` back at most."""
    return int(max(now - hours * HOUR, last_settled if last_settled is not None else 0))


def tick(feeds: dict[str, Callable[[], object]]) -> dict[str, str | None]:
    """Runs each feed to the end of what is there. A feed that fails doesn't stop the others, and, as its checkpoint hasn't
    moved, reads the same again at the next tick. Returns {feed: error or None}."""
    errors: dict[str, str | None] = {}
    for feed, start in feeds.items():
        try:
            query = start()
            if query is not None:
                query.awaitTermination()
            errors[feed] = None
        except Exception as error:  # whatever a feed dies of, the others go on and the caller is told
            errors[feed] = f"{type(error).__name__}: {error}".splitlines()[0]
    return errors


def due(last: dict[str, int | None], every: dict[str, int], now: int) -> list[str]:
    """The slow feeds whose last run is `every` seconds ago or longer, or that never ran."""
    return [f for f, seconds in every.items() if last.get(f) is None or now - last[f] >= seconds]


def backfill(days: list[str], held: list[str], load: Callable[[str], DataFrame], put: Callable[[DataFrame], None], force: bool = False) -> dict[str, str]:
    """Loads days newest last and tells of each: `skipped` (it is held), `written`, or what it failed of; other days go on."""
    told = {}
    for day in sorted(days):
        if day in held and not force:
            told[day] = "skipped"
            continue
        try:
            put(load(day))
            told[day] = "written"
        except Exception as error:  # a day that fails is told, not fatal
            told[day] = f"failed: {type(error).__name__}"
    return told


def price_audit(rows: DataFrame, intervals: int = 288) -> DataFrame:
    """A row a day of prices (day, region, settlement, rrp, capped, intervention, out_of_band): intervals, whether they are too few,
    and how many rows are administered, of an intervention or out of band."""
    flags = [F.count_if(c).alias(f"n_{c}") for c in ("capped", "intervention", "out_of_band")]
    out = rows.groupBy("day").agg(F.count("*").alias("n_rows"), F.count_distinct("settlement").alias("n_intervals"), *flags)
    return out.withColumn("short", F.col("n_intervals") < intervals)


def newest_prices(rows: DataFrame) -> DataFrame:
    """The rows of the newest file; a file that spans more than one settlement is refused."""
    files = rows.groupBy("file").agg(F.min("settlement").alias("first"), F.max("settlement").alias("last"))
    newest = files.agg(F.max_by(F.struct("file", "first", "last"), "file").alias("n")).select("n.*")  # one row
    spans = F.raise_error(F.lit("a price file spans several intervals")).cast(rows.schema["settlement"].dataType)
    held = rows.join(F.broadcast(newest), "file")
    return held.withColumn("settlement", F.when(F.col("first") == F.col("last"), F.col("settlement")).otherwise(spans)).drop("first", "last")


def write_summary(days: DataFrame, keys: list[str], values: list[str], path: str) -> None:
    """One JSON table of sums, least and greatest by key, over all days held; it is written again from the days, never added to."""
    sums = [f(c).alias(f"{n}_{c}") for c in values for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    days.groupBy(*keys).agg(F.count("*").alias("n"), *sums).write.mode("overwrite").json(path)


def newest_a_day(files: DataFrame) -> DataFrame:
    """Of published files (name, which holds its day as yyyymmdd) the greatest name of each day; names without a day are left out."""
    day = F.regexp_extract("name", r"(?:^|[^0-9])((?:19|20)[0-9]{2}[01][0-9][0-3][0-9])(?:[^0-9]|[0-9]{4}[^0-9]|$)", 1)
    return files.select(F.nullif(day, F.lit("")).alias("day"), "name").where("day is not null").groupBy("day").agg(F.max("name").alias("name"))


def summary(rows: DataFrame, key: str, value: str, levels: dict[str, float]) -> DataFrame:
    """What a summary of all days held says of each key: n, mean, least, greatest, and the quantiles at some levels, exact however many rows
    a key has."""
    sums = rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    marks = exact_quantiles(rows, key, value, levels).drop("n").withColumnRenamed(key, "_key")
    return sums.join(marks, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def united(parts: list[DataFrame]) -> DataFrame:
    """Feeds of one schema by name, columns that a feed lacks as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
