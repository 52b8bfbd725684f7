"""Windowed totals of a live stream, and the totals of all that a folder holds so far."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and total value of each type and window of event time; rows later than `late` are dropped once a window closes."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet file or folder of files."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


def gathered(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has given once all that is there has been read, as a table; rows and checkpoint lie in the shared
    folder. In complete mode each micro-batch writes the whole result anew, and the last one is the table."""
    spark, table = stream.sparkSession, f"stream_{uuid.uuid4().hex}"
    base = shared_folder(spark)
    where = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/{table}").trigger(availableNow=True)
    rows = f"{base}/{table}-rows"
    if mode == "complete":
        done: list[int] = []

        def put(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{rows}/batch={n}")
            done.append(n)

        where.foreachBatch(put).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{rows}/batch={max(done)}") if done else spark.createDataFrame([], stream.schema)
    where.format("parquet").start(rows).awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows)


def settled(spark: SparkSession, path: str, width: str, slide: str | None = None) -> DataFrame:
    """What the stream over a path adds up to when all of it has been read: complete mode, open windows included."""
    return gathered(windowed(opened(spark, path), width, slide), "complete")
