"""What a cold start reads: tables that may be missing, days that are out, the newest report, prices in either spelling; and JSON results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.observations import binding, prices

NOTES = "source string, message string"


def loaded(spark: SparkSession, wanted: dict[str, tuple[str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables given as {name: (path, schema)}, and a table of notes (source, message): a path that isn't there gives an empty
    table of the schema and a note. Any other failure to read is raised."""
    tables, notes = {}, []
    for name, (path, schema) in wanted.items():
        try:
            tables[name] = spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            tables[name] = spark.createDataFrame([], schema)
            notes.append((name, f"nothing at {path}"))
    return tables, spark.createDataFrame(notes, NOTES)


def published(days: DataFrame, today: Column, most: int) -> DataFrame:
    """The newest `most` distinct days of a column `day` that are not after today."""
    return days.where(F.col("day") <= today).select("day").distinct().orderBy(F.desc("day")).limit(most)


def _either(df: DataFrame, *names: str) -> Column:
    """The first non-null of the columns that are there; null if none is. Columns are told by place, as case alone doesn't."""
    held = [F.col(f"_{df.columns.index(n)}") for n in names if n in df.columns]
    return F.coalesce(*held) if held else F.lit(None)


def regional_prices(rows: DataFrame) -> DataFrame:
    """Rows (region, at, rrp) from price rows in either spelling of their columns, or both after a merge of files.

    Rows of an intervention repeat an interval and are left out, as are rows without a region, a finite price or an instant.
    """
    # The two spellings.
    out = rows.toDF(*[f"_{i}" for i in range(len(rows.columns))]).select(
        _either(rows, "region", "REGIONID").cast("string").alias("region"), _either(rows, "observed_at", "settlement_ms").cast("long").alias("at"),
        _either(rows, "rrp", "RRP").cast("double").alias("rrp"), F.coalesce(_either(rows, "intervention", "INTERVENTION").cast("int"), F.lit(0)).alias("again"),
    )
    real = ~F.isnan("rrp") & (F.abs("rrp") != float("inf"))
    return out.where((F.col("again") != 1) & F.col("region").isNotNull() & F.col("at").isNotNull() & F.col("rrp").isNotNull() & real).drop("again")


def at_stamp(rows: DataFrame, stamp: Column | None = None) -> DataFrame:
    """The rows of the newest stamp (text whose order is that of time) in a column `stamp`, or of a given one; none there is an error.
    Rows of an intervention are left out where there is a column of that name."""
    newest = rows.where(F.col("stamp") == stamp if stamp is not None else F.col("stamp").isNotNull()).agg(F.max("stamp").alias("stamp"))
    found = F.when(F.col("stamp").isNull(), F.raise_error(F.lit("no report of that stamp")).cast("string")).otherwise(F.col("stamp"))
    base = rows.where(F.coalesce(F.col("intervention") == 0, F.lit(True))) if "intervention" in rows.columns else rows
    # One row by its aggregate, so it can always be sent; it is computed, and refused, even if no row is there to meet it.
    return base.join(F.broadcast(newest.select(found.alias("stamp"))), "stamp").select(*base.columns)


def price_table(rows: DataFrame) -> DataFrame:
    """The binding price of each region and instant from rows (file, region, at, run, line_no, rrp): of the highest run, the first
    line of equal ones. A missing price is refused; `out_of_band` tells of prices beyond the limits."""
    return prices(binding(rows, ["file", "region", "at"], "run", ["line_no"]))


def one_interval(rows: DataFrame) -> DataFrame:
    """`rows` of files that hold one instant each; a file that spans several is refused, not cut down to one of them."""
    spans = rows.groupBy("file").agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    bad = F.raise_error(F.concat(F.col("file"), F.lit(" spans more than one interval"))).cast("long")
    at = F.when(F.col("_lo") == F.col("_hi"), F.col("at")).otherwise(bad)
    return rows.join(spans, "file").withColumn("at", at).select(*rows.columns)


def write_json(rows: DataFrame, path: str) -> None:
    """Results or a registry as lines of JSON, in place of what was there; null fields are kept as such."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `write_json` wrote; a line that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
