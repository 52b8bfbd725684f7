"""Running counts and sums over a table in a global order, hot groups included.

Rows are dealt out by ranges of the order, sorted within each and scanned once; what a range
adds up to is one row, and the ranges before it give each range its start. A group may span any number of ranges.
The scanned table is written to the shared folder, so starts and rows agree whatever is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import released, written

#: A name that tables to be scanned don't have.
PART = "_part"


def _ordered(df: DataFrame, keys: list[Column]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def running(df: DataFrame, order: list[Column], sums: list[str] = (), group: str | None = None, xors: list[str] = (), nth: str = "place") -> DataFrame:
    """`df` with a column `nth`, the rows before a row in the order, and for each of `sums` and `xors` (long columns) the running
    total with the row itself, in a column of that name with `_to` behind.

    With `group` (a long column without nulls, first in the order) all of these begin anew with each group. A row for each
    range goes to the driver, and their starts to the tasks. Equal order keys lie in one range.
    """
    columns, measures = df.columns, [*sums, *xors]
    extra = [pa.field(nth, pa.int64()), *(pa.field(f"{m}_to", pa.int64()) for m in measures)]

    def steps(batch: pa.RecordBatch, carry: list[int], last: int | None) -> tuple[list[np.ndarray], list[int], int | None]:
        """Running values of a batch from those before it; a new group starts at 0."""
        n = batch.num_rows
        keys = batch.column(columns.index(group)).to_numpy() if group else None
        if keys is None:
            starts = np.zeros(1, np.int64)
        else:
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        spread = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        goes_on = keys is None or last == keys[0]
        out, ends = [], []
        for k, name in enumerate([None, *measures]):
            v = np.ones(n, np.int64) if name is None else batch.column(columns.index(name)).to_numpy()
            fold = np.bitwise_xor if name in xors else np.add
            whole = fold.accumulate(v)
            before = np.concatenate([[0], whole[starts[1:] - 1]]).astype(np.int64)
            own = np.bitwise_xor(whole, before[spread]) if name in xors else whole - before[spread]
            if goes_on:
                first = spread == 0
                own[first] = fold(own[first], np.int64(carry[k]))
            ends.append(int(own[-1]))
            out.append(own - 1 if name is None else own)
        return out, ends, None if keys is None else int(keys[-1])

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, carry, last = TaskContext.get().partitionId(), [0] * (1 + len(measures)), None
        for batch in batches:
            if batch.num_rows:
                values, carry, last = steps(batch, carry, last)
                arrays = [*batch.columns, *(pa.array(v) for v in values), pa.array(np.full(batch.num_rows, part, np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *(f.name for f in extra), PART])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`{f.name}` long" for f in extra), f"{PART} long"])
    rows = written(_ordered(df, order).mapInArrow(scan, schema), "scanned")

    # What each range ends with: of its last group, or of all its rows; and the group it begins with.
    totals = [F.max_by(F.struct(F.col(nth).alias("nth"), *(f"{m}_to" for m in measures)), nth).alias("end")]
    if group:
        edges = rows.groupBy(PART).agg(F.min(group).alias("first"), F.max(group).alias("last"))
        ends = rows.join(F.broadcast(edges.select(F.col(PART).alias("_p"), "first", "last")), (F.col(PART) == F.col("_p")) & (F.col(group) == F.col("last")))
        found = ends.groupBy(PART).agg(F.any_value("first").alias("first"), F.any_value("last").alias("last"), *totals).orderBy(PART).collect()  # a row a range
    else:
        found = rows.groupBy(PART).agg(F.lit(0).alias("first"), F.lit(0).alias("last"), *totals).orderBy(PART).collect()  # a row a range
    starts: dict[int, tuple[int, list[int]]] = {}
    carry, open_group = [0] * (1 + len(measures)), None
    for r in found:
        starts[r[PART]] = (r["first"], carry if open_group == r["first"] else [0] * len(carry))
        own = [r["end"]["nth"] + 1, *(r["end"][f"{m}_to"] for m in measures)]
        if r["first"] == r["last"] and open_group == r["first"]:
            carry = [a ^ b if name in xors else a + b for a, b, name in zip(carry, own, [None, *measures], strict=True)]
        else:
            carry = own
        open_group = r["last"]
    if not any(any(c) for _, c in starts.values()):
        return rows.drop(PART)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(len(columns) + len(extra)).to_numpy()
            arrays = list(batch.columns[:-1])
            for part in np.unique(parts):
                first, carry = starts[int(part)]
                if not any(carry):
                    continue
                here = parts == part
                if group:
                    here &= batch.column(columns.index(group)).to_numpy() == first
                for k, name in enumerate([None, *measures]):
                    v = arrays[len(columns) + k].to_numpy(zero_copy_only=False).copy()
                    v[here] = np.bitwise_xor(v[here], np.int64(carry[k])) if name in xors else v[here] + carry[k]
                    arrays[len(columns) + k] = pa.array(v)
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *(f.name for f in extra)])

    return rows.mapInArrow(moved, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`{f.name}` long" for f in extra)]))
