"""Files out of zip archives, nested ones too: a row a file, an archive a task."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError(f"{name} is no zip archive") from e
    for inner in archive.infolist():
        if inner.is_dir():
            continue
        path = f"{name}!{inner.filename}"
        data = archive.read(inner)
        if inner.filename.lower().endswith(".zip"):
            yield from _members(path, data)
        else:
            yield path, data


def unzipped(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """Rows (archive, name, content) of the files in the archives that a path or glob names; archives in archives are opened.

    `name` leads through all archives, parted by `!`. With `single`, an archive that holds other than one file is an
    error, which names it; so is a file that is no archive. An empty archive gives no rows. An archive is held in
    memory by its task, its members one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                n = 0
                for name, data in _members(archive, content):
                    n += 1
                    yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), pa.array([data], pa.binary())], names=["archive", "name", "content"])
                if single and n != 1:
                    raise ValueError(f"{archive} holds {n} files, not one")

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, content binary")
