"""Zip archives, and tables by day, on small files."""

import io
import zipfile

import pytest

from tidewatt.sources import days
from tidewatt.sources.archive import unzipped


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(zipped({"a.csv": b"1"}))
    (tmp_path / "day.zip").write_bytes(zipped({"x.zip": zipped({"b.csv": b"2"}), "y.ZIP": zipped({"c.csv": b"3"})}))
    (tmp_path / "none.zip").write_bytes(zipped({}))
    got = {r.name.split("/")[-1]: bytes(r.content) for r in unzipped(spark, f"file://{tmp_path}/*.zip").collect()}
    assert got == {"one.zip!a.csv": b"1", "day.zip!x.zip!b.csv": b"2", "day.zip!y.ZIP!c.csv": b"3"}
    assert unzipped(spark, f"file://{tmp_path}/one.zip", single=True).count() == 1
    with pytest.raises(Exception, match="holds 2 files"):
        unzipped(spark, f"file://{tmp_path}/day.zip", single=True).collect()
    (tmp_path / "bad.zip").write_bytes(b"text")
    with pytest.raises(Exception, match="no zip archive"):
        unzipped(spark, f"file://{tmp_path}/bad.zip").collect()


SCHEMA = "day string, k int, at int, v double, settled boolean"


def table(spark, path):
    return sorted(tuple(r) for r in spark.read.schema(SCHEMA).parquet(path).select("day", "k", "at", "v", "settled").collect())


def test_days_are_replaced_whole_or_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert days.present(spark, path) == []
    days.replace_days(spark.createDataFrame([("d1", 1, 0, 1.0, True), ("d1", 2, 0, 2.0, True), ("d2", 1, 0, 3.0, True)], SCHEMA), path)
    days.replace_days(spark.createDataFrame([("d1", 9, 0, 9.0, True)], SCHEMA), path)
    days.add_days(spark.createDataFrame([("d2", 5, 0, 5.0, True), ("d3", 6, 0, 6.0, True)], SCHEMA), path)
    assert table(spark, path) == [("d1", 9, 0, 9.0, True), ("d2", 1, 0, 3.0, True), ("d3", 6, 0, 6.0, True)]
    assert days.present(spark, path) == ["d1", "d2", "d3"]


def settled(spark, path):
    return sorted(map(tuple, days.settled_table(spark, path, SCHEMA, ["k"]).read().collect()))


def test_settled_days_win_over_provisional_ones(spark, tmp_path):
    source, path, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        days.settle(spark.readStream.schema(SCHEMA).parquet(source), path, state, ["k"]).awaitTermination()

    arrive([("d1", 1, 5, 1.0, False), ("d1", 2, 5, 2.0, False), ("d2", 1, 7, 3.0, False)])
    arrive([("d1", 1, 6, 1.5, False)])
    assert settled(spark, path) == [("d1", 1, 6, 1.5, False), ("d1", 2, 5, 2.0, False), ("d2", 1, 7, 3.0, False)]
    arrive([("d1", 1, 5, 1.1, True)])
    arrive([("d1", 2, 9, 8.0, False), ("d2", 4, 9, 4.0, False)])
    assert settled(spark, path) == [("d1", 1, 5, 1.1, True), ("d2", 1, 7, 3.0, False), ("d2", 4, 9, 4.0, False)]
