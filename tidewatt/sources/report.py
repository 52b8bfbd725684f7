"""A data source for nested reports: many tables in one text, each headed by its own columns.

Lines start with C (comment, the last one the footer with the number of lines), I (the
columns of a table and version) or D (a row of the table and version last headed so).
`spark.read.format("nested_report")` gives a row for each D line, with its values by column name, or, where
the reader is given a schema, these columns alone. A partition is a file, or a file and table where tables are named;
it reads its file line by line and passes rows on in batches of bounded size. As a stream, each
file is read once, in order of its time and name.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

FORMAT = "nested_report"
SCHEMA = "file string, report string, line_no long, cells map<string,string>"
#: Most rows and characters of a batch.
BATCH_ROWS = 10_000
BATCH_CHARS = 8 << 20
FOOTER = "END OF REPORT"


def fields(line: str) -> list[str]:
    """The fields of a line; quotes count at the start of a field only, and a doubled quote in one stands for itself."""
    return next(csv.reader([line])) if '"' in line else line.split(",")


def rows_of(lines: Iterable[str], tables: frozenset[str] | None = None, check: bool = True) -> Iterator[tuple[str, int, list[str], list[str | None]]]:
    """(table, line number, columns, values) of each row of the tables asked for. Missing trailing and empty values are null.

    A row without a heading, with more values than columns, a line of an unknown kind, and a missing footer or one that
    doesn't fit the number of lines raise ValueError; blank lines don't count. Rows of tables that aren't asked for are
    counted and not looked at.
    """
    heads: dict[str, list[str]] = {}
    declared, n = None, 0
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            continue
        n += 1
        kind = line[0]
        if kind == "D":
            if tables is not None and ".".join(line.split(",", 3)[1:3]).replace('"', "") not in tables:
                continue
            cells = fields(line)
            name, columns = ".".join(cells[1:3]), heads.get(".".join(cells[1:4]))
            if columns is None:
                raise ValueError(f"line {n}: no heading for {name}")
            values = [v or None for v in cells[4:]]
            if len(values) > len(columns):
                raise ValueError(f"line {n}: {len(values)} values for {len(columns)} columns of {name}")
            yield name, n, columns, values + [None] * (len(columns) - len(values))
        elif kind == "I":
            cells = fields(line)
            heads[".".join(cells[1:4])] = cells[4:]
        elif kind == "C":
            last = fields(line)[-1]
            declared = int(last) if FOOTER in line and last.isdigit() else declared
        else:
            raise ValueError(f"line {n}: unknown kind {kind!r}")
    if check and declared is None:
        raise ValueError(f"no footer ({FOOTER}): the report is cut short")
    if check and declared != n:
        raise ValueError(f"the footer says {declared} lines, the report has {n}")


def parse(text: str, tables: frozenset[str] | None = None, check: bool = True) -> Iterator[tuple[str, int, dict[str, str | None]]]:
    """(table, line number, cells) of each row of a report in memory; see `rows_of`."""
    for name, n, columns, values in rows_of(io.StringIO(text, newline="\n"), tables, check):
        yield name, n, dict(zip(columns, values, strict=True))


def _store(path: str):
    """The file system of a path and the path within it: local, or what a URI names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*://?", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[int, str]]:
    """(time, name) of the files under a path, in that order; hidden ones are passed over."""
    from pyarrow import fs

    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[_.][^/]*$", f.path)]
    return sorted(((f.mtime_ns or 0), f.path) for f in files)


@dataclass
class Part(InputPartition):
    """A file, and the tables that a task reads of it (None: all)."""

    file: str
    tables: frozenset[str] | None


class _Reading:
    """What the reader of a folder and of a stream share."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.check = options["path"], options.get("check", "true").lower() == "true"
        named = [t.strip() for t in options.get("tables", "").split(",") if t.strip()]
        self.tables = frozenset(named) if named else None
        self.arrow = to_arrow_schema(schema)
        self.plain = "cells" not in schema.names

    def parts(self, files: Iterable[str]) -> list[Part]:
        each = [frozenset([t]) for t in sorted(self.tables)] if self.tables is not None else [None]
        return [Part(f, t) for f in files for t in each]

    def read(self, part: Part) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        names = self.arrow.names
        kinds = [f.type if f.name in ("file", "report", "line_no", "cells") else pa.string() for f in self.arrow]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            columns = [c if c.type == f.type else pc.cast(c, f.type) for c, f in zip(columns, self.arrow, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=self.arrow)

        store = _store(self.path)[0]
        held, size = [], 0
        with store.open_input_stream(part.file) as raw:
            lines = io.TextIOWrapper(io.BufferedReader(raw, 1 << 20), encoding="utf-8", errors="replace", newline="\n")
            for table, n, columns, values in rows_of(lines, part.tables, self.check):
                if self.plain:  # columns of a given schema; a table without one of them gives null there
                    cells = dict(zip(columns, values, strict=True)) | {"file": part.file, "report": table, "line_no": n}
                    held.append(tuple(cells.get(c) for c in names))
                else:
                    own = {"file": part.file, "report": table, "line_no": n, "cells": list(zip(columns, values, strict=True))}
                    held.append(tuple(own[c] for c in names))
                size += sum(len(v) for v in values if v)
                if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)


class NestedReportReader(_Reading, DataSourceReader):
    """Files as they are when the plan is made. A filter `report = ...` or `report in (...)` chooses tables before lines are split."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            chosen = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if chosen is None or f.attribute != ("report",):
                yield f
            else:
                wanted = frozenset(chosen)
                self.tables = wanted if self.tables is None else self.tables & wanted

    def partitions(self) -> Sequence[InputPartition]:
        return self.parts(f for _, f in _files(self.path)) or [Part("", frozenset())]

    def read(self, part: Part) -> Iterator:
        yield from super().read(part) if part.file else ()


class NestedReportStream(_Reading, DataSourceStreamReader):
    """Files in order of (time, name); an offset is the last one read, so a stream that starts again reads none twice."""

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, to = ((o["time"], o["file"]) for o in (start, end))
        return self.parts(f for at, f in _files(self.path) if after < (at, f) <= to)


class NestedReport(DataSource):
    """Options: path; tables, names with commas between; check, whether footers must fit."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return NestedReportReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return NestedReportStream(schema, self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the format `nested_report` and filters that Python sources see."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NestedReport)
    return spark


def read_reports(spark: SparkSession, path: str, tables: list[str] | None = None, check: bool = True, schema: str | None = None, stream: bool = False) -> DataFrame:
    """All rows of the reports under a path, or those of the tables named; with a schema, its columns of these rows."""
    reader = registered(spark).readStream if stream else registered(spark).read
    reader = reader.format(FORMAT).option("check", str(check).lower()).option("tables", ",".join(tables or []))
    return (reader.schema(schema) if schema else reader).load(path)
