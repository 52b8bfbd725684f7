"""A table with versions: rows merged by key, and readers that see all of a commit or nothing of it.

Data lie in folders that are written once; a numbered manifest names the folder of each part
(a day, an interval) and what streams have committed. A commit is the exclusive creation of the next manifest. Who
finds that number taken reads what was committed and merges anew, so no rows are lost; who breaks off before it leaves folders
that no manifest names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Commits that are tried again when others come first.
ATTEMPTS = 20


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none where there is no folder."""
    fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(_path(spark, path))) if fs.exists(_path(spark, path)) else []


def published(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with this text unless there is one of its name; of several writers one gets True. The file is never seen
    in part: it is written aside and takes its name in one step, that fails where the name is taken."""
    fs, aside = _fs(spark, path), f"{path}.{uuid.uuid4().hex}.aside"
    out = fs.create(_path(spark, aside), False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":  # a link is the exclusive step there
            os.link(*(_path(spark, p).toUri().getPath() for p in (aside, path)))
            return True
        jvm = spark._jvm
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
        context.rename(_path(spark, aside), _path(spark, path), options)
        return True
    except FileExistsError:
        return False
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    finally:
        fs.delete(_path(spark, aside), False)


def text_at(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest_by(keys: list[str], at: str) -> Callable[[DataFrame], DataFrame]:
    """Of the rows of a key the one of greatest `at` stays; of equally late ones the greatest row."""

    def resolve(rows: DataFrame) -> DataFrame:
        every = F.struct(*rows.columns)
        return rows.groupBy(*keys).agg(F.max_by(every, F.struct(F.col(at).alias("_at"), every.alias("_row"))).alias("row")).select("row.*")

    return resolve


class VersionedTable:
    """A table of a given schema under a path, in parts by one column (text in manifests; null is a part too).

    `merge` takes the rows of the parts it touches, held and new, through `resolve`, which must give the same whatever the order
    and batches in which they come. A manifest lists parts, so parts should be days or intervals and not keys.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, part: str, resolve: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.part, self.resolve = spark, path.rstrip("/"), part, resolve
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, f"{self.path}/_log") if re.fullmatch(r"\d{12}\.json", n)]

    def manifest(self, version: int | None = None) -> dict:
        """{version, parts: {part: folder}, done: {writer: its last batch}} of a version, by default the latest."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "parts": {}, "done": {}}
        return json.loads(text_at(self.spark, f"{self.path}/_log/{known[-1] if version is None else version:012d}.json"))

    def parts(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["parts"])

    def _rows(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version; commits made later don't change it."""
        return self._rows(sorted(self.manifest(version)["parts"].values()))

    def _commit(self, seen: dict, parts: dict[str, str], writer: tuple[str, int] | None) -> bool:
        done = seen["done"] | ({writer[0]: writer[1]} if writer else {})
        text = json.dumps({"version": seen["version"] + 1, "parts": parts, "done": done}, sort_keys=True)
        return published(self.spark, f"{self.path}/_log/{seen['version'] + 1:012d}.json", text)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows in a new folder, and {part: folder} of what was written; a part's rows are dealt by hash, so a large one has several files."""
        folder = f"data/{uuid.uuid4().hex}"
        named = rows.select(*self.schema.names).withColumn("_part", F.coalesce(F.col(self.part).cast("string"), F.lit("")))
        named.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        unquoted = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        found = [n for n in names(self.spark, f"{self.path}/{folder}") if n.startswith("_part=")]
        return {("" if n == "_part=__HIVE_DEFAULT_PARTITION__" else unquoted(n[6:])): f"{folder}/{n}" for n in found}

    def merge(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Merges rows into the table; False if this writer has committed this batch or a later one before.

        The rows are written aside first, so a source is read once, and what is held of their parts is read again for each attempt.
        """
        if writer is not None and self.manifest()["done"].get(writer, -1) >= batch:
            return False
        fresh = self._write(rows)
        for _ in range(ATTEMPTS):
            seen = self.manifest()
            if writer is not None and seen["done"].get(writer, -1) >= batch:
                return False
            held = [seen["parts"][p] for p in fresh if p in seen["parts"]]
            merged = self._rows([*held, *fresh.values()])
            out = fresh if self.resolve is None and not held else self._write(self.resolve(merged) if self.resolve else merged)
            if self._commit(seen, seen["parts"] | out, (writer, batch) if writer is not None else None):
                return True
        raise RuntimeError(f"{ATTEMPTS} commits of others came first")

    def replace(self, rows: DataFrame) -> None:
        """The parts among the rows hold these rows only."""
        fresh = self._write(rows)
        while not self._commit(seen := self.manifest(), seen["parts"] | fresh, None):
            pass

    def drop(self, gone: Callable[[str], bool]) -> int:
        """Leaves out the parts told by name, and returns how many; their files stay until `vacuum`."""
        while True:
            seen = self.manifest()
            kept = {p: f for p, f in seen["parts"].items() if not gone(p)}
            if len(kept) == len(seen["parts"]) or self._commit(seen, kept, None):
                return len(seen["parts"]) - len(kept)

    def vacuum(self, keep: int = 2, older_than_s: float = 3600.0) -> int:
        """Deletes the manifests but the last `keep`, and folders that none of these names and nobody has written to for a while."""
        known = self.versions()
        used = {f.split("/")[1] for v in known[-keep:] for f in self.manifest(v)["parts"].values()}
        fs, gone = _fs(self.spark, self.path), 0
        for v in known[:-keep]:
            fs.delete(_path(self.spark, f"{self.path}/_log/{v:012d}.json"), False)
        now = self.spark._jvm.System.currentTimeMillis()
        for name in names(self.spark, f"{self.path}/data"):
            at = _path(self.spark, f"{self.path}/data/{name}")
            if name not in used and now - fs.getFileStatus(at).getModificationTime() >= older_than_s * 1000:
                fs.delete(at, True)
                gone += 1
        return gone
