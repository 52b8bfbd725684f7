"""Ordered recurrences x -> a * x + b over a group's rows, split over any number of tasks.

Steps of that form compose: (a, b) then (c, d) is (a * c, b * c + d). Rows are dealt out by ranges of the order, each range is
folded apart, and what it adds up to is one pair; the pairs of the ranges are scanned, and give each
range what came before it. A group with any part of all rows so takes as many tasks as it has ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Columns that tables must not have.
PART, SCALE, SHIFT, GROUP = "_part", "_scale", "_shift", "_group"


def affine_prefix(rows: DataFrame, group: Column, order: list[Column], scale: Column, shift: Column, name: str) -> DataFrame:
    """`rows` with a column `name`: x after each row of its group in the order, where a row takes x to scale * x + shift and a group
    begins with 0. The order should tell a group's rows apart; rows with a null group are a group.

    A row for each range goes to the driver, and one number for each range to the tasks. The folded table is written to the
    shared folder, so that ranges and rows agree whatever is run again.
    """
    spark, columns = rows.sparkSession, rows.columns
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", F.coalesce(group.cast("string"), F.lit("")).alias(GROUP), scale.cast("double").alias(SCALE), shift.cast("double").alias(SHIFT))
    keys = [F.col(GROUP).asc(), *order]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, scale, shift, first = TaskContext.get().partitionId(), None, 1.0, 0.0, True
        for batch in batches:
            scales, shifts = [], []
            for g, a, b in zip(*(batch.column(len(columns) + k).to_pylist() for k in range(3)), strict=True):
                if g != before and not first:  # a group that begins here doesn't depend on what came before
                    scale, shift = 0.0, 0.0
                scale, shift = scale * a, shift * a + b
                before, first = g, False
                scales.append(scale)
                shifts.append(shift)
            arrays = [*batch.columns[: len(columns) + 1], pa.array(scales, pa.float64()), pa.array(shifts, pa.float64()), pa.array([part] * len(scales), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, GROUP, SCALE, SHIFT, PART])

    path = f"{shared_folder(spark)}/prefix-{uuid.uuid4().hex}"
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"{GROUP} string, {SCALE} double, {SHIFT} double, {PART} long"])
    dealt = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt.mapInArrow(fold, schema).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    folded = spark.read.parquet(path)

    ends = folded.groupBy(PART).agg(F.min(GROUP).alias("first"), F.max(GROUP).alias("last"), F.max_by(F.struct(SCALE, SHIFT), "_place").alias("end"))
    carries, x, last = [], 0.0, None
    for r in ends.orderBy(PART).collect():  # a row a range
        x = x if r["first"] == last else 0.0
        carries.append((r[PART], x))
        x, last = r["end"][SCALE] * x + r["end"][SHIFT], r["last"]
    starts = F.broadcast(spark.createDataFrame(carries, "_at long, _x double"))  # a row a range
    out = folded.join(starts, F.col(PART) == F.col("_at"))
    return out.select(*columns, (F.col(SCALE) * F.col("_x") + F.col(SHIFT)).alias(name))


def rank_in_group(rows: DataFrame, group: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """`rows` with their number from 1 in their group, in an order that tells them apart."""
    return affine_prefix(rows, group, order, F.lit(1.0), F.lit(1.0), name).withColumn(name, F.col(name).cast("long"))
