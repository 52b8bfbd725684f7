"""Batches of documents loaded in one pass, each failure a row beside the result; weather of the archive and of forecasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nested import weather

DAY = 86_400
#: The shape of a batch of weather responses, of some of its variables.
HOURLY = "station: string, issued_at: long, hourly: struct<time: array<long>, {variables}>"


def weather_schema(variables: list[str]) -> str:
    return "data array<struct<" + HOURLY.format(variables=", ".join(f"{v}: array<double>" for v in variables)) + ">>"


def load(docs: DataFrame, rows_of: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """Rows, and what became of each file (file, state, n_rows), of `nested.documents`. `rows_of` takes the readable ones to rows with
    their `file`; it may give a file a state of its own by rows with `failed` not null, whose file is then left out whole.

    Files are read and decoded once, into the folder `path`; whatever is in one file, the others are loaded. States are written, empty (no
    rows), broken, too big or what `failed` says. It is an error only if there are files and none gave a row.
    """
    spark = docs.sparkSession
    docs.write.parquet(f"{path}/docs")
    held = spark.read.schema(docs.schema).parquet(f"{path}/docs")
    rows_of(held.where("state = 'ok'")).write.parquet(f"{path}/rows")
    found = spark.read.parquet(f"{path}/rows")
    counts = found.groupBy(F.col("file").alias("_file")).agg(F.count_if(F.col("failed").isNull()).alias("n"), F.max("failed").alias("why"))
    state = F.when(F.col("state") != "ok", F.col("state")).when(F.col("why").isNotNull(), F.col("why")).when(F.coalesce("n", F.lit(0)) == 0, "empty").otherwise("written")
    told = held.select("file", "state").join(counts, F.col("file") == F.col("_file"), "left")
    told = told.select("file", state.alias("state"), F.when(state == "written", F.col("n")).otherwise(0).cast("long").alias("n_rows"))
    told.write.parquet(f"{path}/told")
    told = spark.read.parquet(f"{path}/told")
    total = told.agg(F.count("*").alias("files"), F.sum("n_rows").alias("rows")).first()  # one row
    if total.files and not total.rows:
        raise ValueError(f"none of {total.files} batches gave a row")
    good = told.where("state = 'written'").select(F.col("file").alias("_file"))
    return found.join(good, F.col("file") == F.col("_file"), "left_semi").drop("failed"), told


def weather_rows(variables: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Rows (file, station, variable, at, value, issued_at) of documents of `weather_schema`; a response whose lists differ in length, or without
    a station or times, makes its file fail as `uneven`."""

    def rows_of(docs: DataFrame) -> DataFrame:
        each = docs.select("file", F.explode_outer("body.data").alias("r")).where("r is not null").select("file", "r.*")
        uneven: Column = F.col("station").isNull() | F.col("hourly.time").isNull()
        for v in variables:
            uneven = uneven | F.coalesce(F.size(f"hourly.{v}") != F.size("hourly.time"), F.lit(False))
        keyed = each.withColumns({"failed": F.when(uneven, F.lit("uneven")), "who": F.struct("file", "station", "issued_at")})
        good = weather(keyed.where("failed is null").select(F.col("who").alias("station"), "hourly"), variables)
        good = good.select("station.file", "station.station", "variable", "at", "value", "station.issued_at", F.lit(None).cast("string").alias("failed"))
        bad = keyed.where("failed is not null").select("file", "station", F.lit(None).cast("string").alias("variable"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("value"), "issued_at", "failed")
        return good.unionByName(bad)

    return rows_of


def merged_weather(archive: DataFrame, forecast: DataFrame, overlap_s: int = DAY) -> DataFrame:
    """Archive and forecast rows (station, variable, at, value; forecasts with issued_at) as one series a station and variable: value, source and
    issued_at. The archive wins; forecasts are taken from `overlap_s` before a station's last archived hour on, the newest issue
    of an hour; stations without archive take all of theirs."""
    last = archive.groupBy(F.col("station").alias("_s")).agg(F.max("at").alias("_last"))
    newest = forecast.groupBy("station", "variable", "at").agg(F.max_by(F.struct("value", "issued_at"), F.struct("issued_at", "value")).alias("f"))
    newest = newest.join(last, F.col("station") == F.col("_s"), "left").where(F.col("_last").isNull() | (F.col("at") >= F.col("_last") - overlap_s)).select("station", "variable", "at", "f")
    held = archive.groupBy("station", "variable", "at").agg(F.max("value").alias("v"))
    out = held.join(newest, ["station", "variable", "at"], "full")
    own = F.col("v").isNotNull()
    return out.select("station", "variable", "at", F.coalesce("v", "f.value").alias("value"), F.when(own, "archive").otherwise("forecast").alias("source"), F.when(~own, F.col("f.issued_at")).alias("issued_at"))
