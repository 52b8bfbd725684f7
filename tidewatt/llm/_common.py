"""Shared folder, written tables and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
#: Most bytes of its files.
BROADCAST_BYTES = 32 << 20

#: Characters that separate words: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`). Where it is unset, one of our own if the master is
    local; an error on a cluster, where a folder of one machine would lose rows."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scope:
    """The tables that one call has written to the shared folder. A scope belongs to its call and thread, so calls that run at
    the same time don't see each other's tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def drop(self, keep: int = 1) -> None:
        """Deletes the tables but the last `keep`, once nothing reads the others any more."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for name in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_open = threading.local()


def _scopes(spark: SparkSession) -> list[Scope]:
    if not hasattr(_open, "scopes"):
        _open.scopes = [Scope(spark)]
    return _open.scopes


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables written within belong to the scope; what it hasn't dropped passes to the enclosing one when it ends."""
    held = Scope(spark)
    _scopes(spark).append(held)
    try:
        yield held
    finally:
        _scopes(spark).remove(held)
        _scopes(spark)[-1].paths += held.paths


def claimed(spark: SparkSession, path: str) -> str:
    """A path in the shared folder that is deleted with the tables of the scope."""
    _scopes(spark)[-1].paths.append(path)
    return path


def written(df: DataFrame, name: str, *more: Column) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors.

    Its rows are counted as they are written; `counts` has them, and the values of `more`, named aggregates."""
    spark = df.sparkSession
    path = claimed(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *more).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = files.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(files).getLength()
    _measured[out] = seen.get | {"bytes": size}
    return out


_measured: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def counts(table: DataFrame) -> dict:
    """What was counted as a table was written: rows, bytes (of its files), and any named aggregates."""
    return _measured[table]


def clear_written(spark: SparkSession) -> None:
    """Deletes all tables that calls of this thread left; for when no result that reads them is needed any more."""
    _scopes(spark)[-1].drop(0)


def released(run: Callable) -> Callable:
    """A map over Arrow batches that gives freed memory back to the system when it ends, as workers wait for the next one."""

    @wraps(run)
    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A written table marked for broadcast if it has at most `rows` rows and its files at most `size` bytes, else as it is. What was
    counted as it was written is taken; other tables are counted by rows, and must have rows of bounded width."""
    known = _measured.get(df)
    few = known["rows"] <= rows and known["bytes"] <= size if known else df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of maximal runs without white space (space, U+0009 to U+000D)."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")
