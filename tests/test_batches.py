"""Batches of documents: failures beside the result, each file read once; archive and forecasts merged."""

import json

import pytest

from tidewatt.plans import weather
from tidewatt.sources import batches, nested

V = ["temperature_2m"]


def put(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))


def doc(station, times, values, issued=None):
    return {"data": [{"station": station, "issued_at": issued, "hourly": {"time": times, "temperature_2m": values}}]}


def loaded(spark, tmp_path, name):
    docs = nested.documents(spark, str(tmp_path / "in"), batches.weather_schema(V), most_bytes=2000)
    return batches.load(docs, batches.weather_rows(V), f"file://{tmp_path}/{name}")


def test_a_failed_batch_is_told_and_the_others_are_written(spark, tmp_path):
    put(tmp_path / "in", "a.json", doc("A", [0, 3600], [1.0, None]))
    put(tmp_path / "in", "b.json", '{"data": [')
    put(tmp_path / "in", "c.json", doc("C", [0, 3600], [1.0]))
    put(tmp_path / "in", "d.json", {"data": []})
    put(tmp_path / "in", "e.json", doc("E", list(range(500)), [0.0] * 500))
    put(tmp_path / "in", "f.json", {"data": doc("F", [7200], [5.0], 9)["data"] + [{"hourly": None}]})
    put(tmp_path / "in", "g.json", doc("G", [7200], [5.0], 9))
    rows, told = loaded(spark, tmp_path, "out")
    assert {r.file: (r.state, r.n_rows) for r in told.collect()} == {"a.json": ("written", 1), "b.json": ("broken", 0), "c.json": ("uneven", 0), "d.json": ("empty", 0), "e.json": ("too big", 0), "f.json": ("uneven", 0), "g.json": ("written", 1)}
    assert {tuple(r) for r in rows.collect()} == {("a.json", "A", "temperature_2m", 0, 1.0, None), ("g.json", "G", "temperature_2m", 7200, 5.0, 9)}
    for f in (tmp_path / "in").iterdir():
        f.unlink()  # nothing is read again
    assert rows.count() == 2 and told.count() == 7


def test_documents_that_are_lines_have_the_same_fates_as_files(spark, tmp_path):
    many = {
        "a": json.dumps(doc("A", [0, 3600], [1.0, None])), "b": '{"data": [', "c": json.dumps(doc("C", [0, 3600], [1.0])), "d": '{"data": []}', "e": json.dumps(doc("E", list(range(500)), [0.0] * 500)),
        "g": json.dumps(doc("G \u00e9\tx", [7200], [5.0], 9), ensure_ascii=False), "i": "\t",
    }
    for k, body in many.items():
        put(tmp_path / "in", k, body)
    (tmp_path / "lines").mkdir()
    for n, names in enumerate(("abc", "degi")):
        (tmp_path / "lines" / f"{n}.txt").write_text("".join(f"{k}\t{many[k]}\n" for k in names))
    as_lines = nested.lines(spark, str(tmp_path / "lines"), batches.weather_schema(V), most_bytes=2000)
    as_files = nested.documents(spark, str(tmp_path / "in"), batches.weather_schema(V), most_bytes=2000)
    assert sorted(map(str, as_lines.collect())) == sorted(map(str, as_files.collect()))
    rows, told = (batches.load(d, batches.weather_rows(V), f"file://{tmp_path}/{n}") for n, d in (("l", as_lines), ("f", as_files)))
    assert {tuple(r) for r in rows[0].collect()} == {tuple(r) for r in told[0].collect()} and {tuple(r) for r in rows[1].collect()} == {tuple(r) for r in told[1].collect()}
    (tmp_path / "bare.txt").write_text("h\n\n")
    assert [(r.file, r.bytes, r.state) for r in nested.lines(spark, str(tmp_path / "bare.txt"), batches.weather_schema(V)).collect()] == [("h", 0, "broken"), ("", 0, "broken")]


def test_the_weather_queries_write_fewer_files_than_documents(spark):
    path = weather._written(spark, "/root/testdata/sf0.001")
    assert spark.read.text(path).count() > 20 and len(spark.read.text(path).inputFiles()) <= 2 * 4


def test_only_if_nothing_was_written_it_fails(spark, tmp_path):
    put(tmp_path / "in", "b.json", "{")
    with pytest.raises(ValueError, match="none of 1 batches"):
        loaded(spark, tmp_path, "out")
    (tmp_path / "in" / "b.json").unlink()
    rows, told = loaded(spark, tmp_path, "none")
    assert rows.count() == told.count() == 0


def test_the_archive_wins_and_the_newest_forecast_goes_on(spark):
    kind = "station string, variable string, at long, value double"
    archive = spark.createDataFrame([("A", "t", h * 3600, float(h)) for h in range(48)], kind)
    forecast = spark.createDataFrame([("A", "t", h * 3600, 100.0 + h, issue) for h in (1, 46, 47, 48, 49) for issue in (1, 2)] + [("B", "t", 0, 7.0, 1), ("A", "u", 30 * 3600, 8.0, 1), ("A", "u", 3600, 9.0, 1)], kind + ", issued_at long")
    got = {(r.station, r.variable, r["at"] // 3600): (r.value, r.source, r.issued_at) for r in batches.merged_weather(archive, forecast).collect()}
    assert len(got) == 48 + 2 + 1 + 1
    assert got["A", "t", 47] == (47.0, "archive", None) and got["A", "t", 48] == (148.0, "forecast", 2) and got["B", "t", 0] == (7.0, "forecast", 1)
    assert got["A", "u", 30] == (8.0, "forecast", 1) and ("A", "u", 1) not in got  # more than a day before the archive's end
