"""Tables kept by day: whole days are replaced, days that are there can be skipped, settled days win over provisional ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import VersionedTable, latest_by, names


def present(spark: SparkSession, path: str) -> list[str]:
    """The days a table holds, from the names of its folders; none where there is no table."""
    return [n.removeprefix("day=") for n in names(spark, path) if n.startswith("day=")]


def replace_days(rows: DataFrame, path: str) -> None:
    """Writes rows by their column `day`; days among them are replaced whole, other days stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def add_days(rows: DataFrame, path: str) -> None:
    """Writes the rows of days that the table doesn't hold yet."""
    known = present(rows.sparkSession, path)
    replace_days(rows.where(~F.col("day").cast("string").isin(known)) if known else rows, path)


def settle_rule(keys: list[str]):
    """Of a day's rows the settled ones if there are any, else the provisional ones; of each key the newest by `at`."""

    def resolve(rows: DataFrame) -> DataFrame:
        day = rows.groupBy("day").agg(F.max("settled").alias("_settled"))
        stays = rows.join(day.withColumnRenamed("day", "_day"), F.col("day").eqNullSafe(F.col("_day")) & (F.col("settled") == F.col("_settled")))
        return latest_by(["day", *keys], "at")(stays.select(*rows.columns))

    return resolve


def settled_table(spark: SparkSession, path: str, schema: StructType | str, keys: list[str]) -> VersionedTable:
    """A table by day of rows (day, settled, at, keys, values), settled rows over provisional ones."""
    return VersionedTable(spark, path, schema, "day", settle_rule(keys))


def settle(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Starts a stream of rows (day, settled, at, keys, values) into a `settled_table` and returns the query.

    Rows of a day may come in any number of micro-batches: settled ones are gathered, and provisional ones give way to
    them whenever they come. A micro-batch that is run again changes nothing, and readers see whole commits.
    """

    def put(batch: DataFrame, number: int) -> None:
        settled_table(batch.sparkSession, path, stream.schema, keys).merge(batch, checkpoint, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
