"""Nested JSON documents: readings of facilities, dispatch solutions, weather of stations; and the folds of their rows.

A file is one document and is read within one task, so files of any number are spread over the cluster; small documents can be
lines of fewer files. The size of a document is bounded by `most_bytes`, beyond which it is reported and passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import round3
from ..operators.observations import MOST_OF_CAPACITY, strict_instant, to_mw

READINGS = "data struct<facilityScadaDispatchIntervals: array<struct<dispatchInterval: string, code: string, quantity: double>>>"
SOLUTION = (
    "data struct<primaryDispatchInterval: string, solutionData: array<struct<dispatchInterval: string,"
    " facilityScheduleDetails: array<struct<facilityCode: string, initialMw: double>>,"
    " dispatchCaps: array<struct<facilityCode: string, dispatchCap: double>>>>>"
)
MOST_BYTES = 48 << 20
#: Variables given as the mean of the hour before their stamp.
HOUR_MEANS = ("shortwave_radiation", "direct_normal_irradiance", "diffuse_radiation")


def documents(spark: SparkSession, path: str, schema: str, since: str | None = None, most_bytes: int = MOST_BYTES, parts: int = 1) -> DataFrame:
    """Rows (file, bytes, state, body) of the JSON files of a folder whose name comes after `since`.

    `state` is `ok`, `too big` or `broken`; the body of the latter two is null, so that a reader can go past them. Contents of files
    that are too big aren't decoded. `file` is the last `parts` parts of the path, which should tell files apart.
    """
    name = F.array_join(F.slice(F.split("path", "/"), F.lit(-parts), F.lit(parts)), "/")
    files = spark.read.format("binaryFile").load(path).select(name.alias("file"), F.col("length").alias("bytes"), "content")
    return _decoded(files if since is None else files.where(F.col("file") > since), schema, most_bytes)


def lines(spark: SparkSession, path: str, schema: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """As `documents`, of text files with a document a line: its name, a tab, and its JSON without line ends.

    For documents that are small and many, each of which would else be a file to make, list and open. A line has the state
    of its own document, whatever is in others of its file.
    """
    name, at = F.substring_index("value", "\t", 1), F.instr("value", "\t")
    rows = spark.read.text(path).select(name.alias("file"), F.when(at > 0, F.expr("substring(value, instr(value, '\t') + 1)")).otherwise("").alias("content"))
    return _decoded(rows.select("file", F.octet_length("content").cast("long").alias("bytes"), "content"), schema, most_bytes)


def _decoded(files: DataFrame, schema: str, most_bytes: int) -> DataFrame:
    fits = F.col("bytes") <= most_bytes
    # A body that can't be read is null, a body without its parts has null fields.
    body = F.when(fits, F.from_json(F.try_validate_utf8(F.col("content").cast("string")), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    read = files.select("file", "bytes", fits.alias("fits"), body.alias("body"))
    state = F.when(~F.col("fits"), "too big").when(F.col("body").isNull() | F.col("body._bad").isNotNull(), "broken").otherwise("ok")
    return read.select("file", "bytes", state.alias("state"), F.when(state == "ok", F.struct("body.data")).alias("body"))


def readings(docs: DataFrame) -> DataFrame:
    """Rows (file, at, code, mw) of documents of facility readings; a readable document without the array is refused. The stamp is the
    interval's start; quantities are MWh of five minutes; null ones are left out."""
    held = F.col("body.data.facilityScadaDispatchIntervals")
    array = F.when(held.isNull(), F.raise_error(F.concat(F.lit("no readings in "), F.col("file"))).cast("array<struct<dispatchInterval:string,code:string,quantity:double>>")).otherwise(held)
    rows = docs.where("state = 'ok'").select("file", F.explode(array).alias("r"))
    return rows.select("file", strict_instant(F.col("r.dispatchInterval")).alias("at"), F.col("r.code").alias("code"), to_mw(F.col("r.quantity"), F.lit("MWh")).alias("mw")).where("mw is not null and not isnan(mw)")


def archive_fold(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows (station, at, mw, facilities, quality) from readings and codes (code, station, capacity): sums to 3 places, `suspect` over
    MOST_OF_CAPACITY of a known capacity. Unknown codes drop out."""
    out = rows.join(codes, "code").groupBy("station", "at").agg(F.sum("mw").alias("mw"), F.count("*").alias("facilities"), F.max("capacity").alias("capacity"))
    out = out.withColumn("mw", round3(F.col("mw")))
    over = (F.col("capacity") > 0) & (F.col("mw") > MOST_OF_CAPACITY * F.col("capacity"))
    return out.select("station", "at", "mw", "facilities", F.when(over, "suspect").otherwise("ok").alias("quality"))


def binding_run(docs: DataFrame) -> DataFrame:
    """Rows (file, run): of each solution the run of its primary interval, else the first. Projections are left out."""
    runs = F.col("body.data.solutionData")
    primary = F.filter(runs, lambda r: r["dispatchInterval"] == F.col("body.data.primaryDispatchInterval"))
    return docs.where("state = 'ok'").select("file", F.coalesce(F.get(primary, F.lit(0)), F.get(runs, F.lit(0))).alias("run")).where("run is not null")


def solution_outputs(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows (file, station, at, mw, facilities, capped) of the binding runs, with codes (code, station).

    Outputs describe the interval's start, five minutes before its stamp. A station is capped if one of its facilities is.
    """
    runs = binding_run(docs).select("file", (strict_instant(F.col("run.dispatchInterval")) - F.expr("interval 5 minutes")).alias("at"), "run")
    capped = F.transform(F.filter(F.coalesce("run.dispatchCaps", F.array().cast("array<struct<facilityCode:string,dispatchCap:double>>")), lambda c: c["dispatchCap"].isNotNull()), lambda c: c["facilityCode"])
    rows = runs.select("file", "at", capped.alias("held"), F.explode("run.facilityScheduleDetails").alias("f")).where("f.initialMw is not null")
    rows = rows.select("file", "at", F.col("f.facilityCode").alias("code"), F.col("f.initialMw").alias("mw"), F.array_contains("held", F.col("f.facilityCode")).alias("held"))
    out = rows.join(codes, "code").groupBy("file", "station", "at").agg(F.sum("mw").alias("mw"), F.count("*").alias("facilities"), F.bool_or("held").alias("capped"))
    return out.withColumn("mw", round3(F.col("mw")))


def weather(responses: DataFrame, variables: list[str]) -> DataFrame:
    """Rows (station, variable, at, value) from responses (station, hourly struct<time: array<long>, variable: array<double>...>).

    Null samples are left out. The mean of an hour is set half an hour before its stamp, other variables stay.
    """
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(-1800 if v in HOUR_MEANS else 0).alias("by"), F.arrays_zip(F.col("hourly.time").alias("t"), F.col(f"hourly.{v}").alias("v")).alias("samples")) for v in variables])
    rows = responses.select("station", F.explode(each).alias("s")).select("station", "s.variable", "s.by", F.explode("s.samples").alias("x"))
    return rows.where("x.v is not null").select("station", "variable", (F.col("x.t") + F.col("by")).alias("at"), F.col("x.v").alias("value"))


def request_groups(stations: DataFrame, variables: Column, size: int = 12) -> DataFrame:
    """Rows (variables, batch, stations): stations that need the same variables, `size` to a batch at most; those that need
    none are left out. Batches are numbered by hash, so no group is sorted in one task."""
    need = stations.withColumn("variables", variables).where(F.size("variables") > 0)
    counts = need.groupBy("variables").agg(F.count("*").alias("n"))
    # A bucket holds so few stations that cutting it is a matter of one short array.
    spread = need.join(counts, "variables").withColumn("bucket", F.pmod(F.xxhash64("station"), F.greatest(F.lit(1), F.floor(F.col("n") / (64 * size)))))
    held = spread.groupBy("variables", "bucket").agg(F.sort_array(F.collect_list("station")).alias("all"))
    starts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / size).cast("int"))
    cut = held.select("variables", "bucket", "all", F.explode(starts).alias("i"))
    return cut.select("variables", F.concat_ws("-", "bucket", "i").alias("batch"), F.slice("all", F.col("i") * size + 1, F.lit(size)).alias("stations"))


def flows_fold(rows: DataFrame) -> DataFrame:
    """Rows (at, demand, flow), maps by region and link, from rows (at, kind, name, intervention, mw), kind `demand` or `flow`.

    Where an instant has rows of an intervention, only these count. To one place; rows that aren't finite are left out, but still
    tell an intervention. Of repeats the largest value stays.
    """
    least = rows.groupBy("at").agg(F.max(F.coalesce(F.col("intervention") == 1, F.lit(False))).alias("stepped_in"))
    named = rows.groupBy("at", "kind", "name", F.coalesce(F.col("intervention") == 1, F.lit(False)).alias("stepped_in")).agg(F.max(F.when(~F.isnan("mw") & (F.abs("mw") != float("inf")), F.col("mw"))).alias("mw"))
    binding = named.join(least, ["at", "stepped_in"]).where("mw is not null").withColumn("mw", F.floor(F.col("mw") * 10 + 0.5) / 10)

    def held(kind: str) -> Column:
        entries = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "mw"))))
        return F.map_from_entries(entries).alias(kind)

    return least.select("at").join(binding.groupBy("at").agg(held("demand"), held("flow")), "at", "left")
