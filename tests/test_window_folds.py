"""Window folds, loaders, derived weather and JSON results on small, hand-checked inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tidewatt import plans
from tidewatt.functions import features
from tidewatt.operators import sweeps
from tidewatt.sources import loading, report

ROW = "at long, unit string, intervention int, mw double, cleared double, availability double, uigf double, capped boolean"


def fleet(spark):
    units = spark.createDataFrame([("a1", "A", None), ("a2", "A", "GENERATOR"), ("b1", "B", "LOAD"), ("b2", "B", "GENERATOR")], "unit string, station string, dispatch_type string")
    return units, spark.createDataFrame([("A", 10.0), ("B", None)], "station string, capacity double")


def test_a_day_folds_missing_values_to_nothing(spark):
    rows = [
        (600, "a1", 0, 5.0, 4.0, 6.0, 7.0, True), (600, "a2", None, None, None, None, None, None), (600, "a2", 1, 99.0, 9.0, 9.0, 9.0, True),
        (900, "a1", 0, 12.0, 1.0, 1.0, None, False), (900, "zz", 0, 50.0, 1.0, 1.0, 1.0, True), (600, "b1", 0, -3.0, 0.0, 0.0, 1.0, False), (600, "b2", 0, 500.0, 0.0, 0.0, None, False),
    ]
    got = {(r.station, r["at"]): r for r in sweeps.day_fold(spark.createDataFrame(rows, ROW), *fleet(spark)).collect()}
    assert set(got) == {("A", 300), ("A", 600), ("B", 300)}
    a = got["A", 300]
    assert (a.output_mw, a.cleared_mw, a.available_mw, a.uigf_mw, a.curtailed_mw, a.capped, a.online, a.units, a.quality) == (5.0, 4.0, 6.0, 7.0, 2.0, True, 1, 2, "ok")
    assert (got["A", 600].quality, got["A", 600].uigf_mw, got["A", 600].curtailed_mw) == ("suspect", None, 0.0)
    assert (got["B", 300].output_mw, got["B", 300].quality, got["B", 300].capped) == (497.0, "ok", False)


def test_a_sweep_leaves_loads_out_and_judges_by_the_window(spark):
    rows = [(300, "a1", 0, 1.0, 1.0, 0.0, None, None), (600, "a1", 0, 2.0, 1.0, 0.0, 3.0, None), (600, "a2", 0, 2.0, 1.0, 0.0, None, True), (300, "b1", 0, -9.0, 0.0, 0.0, None, False), (300, "b2", 0, 1.0, 0.0, 0.0, None, False)]
    got = {tuple(r) for r in sweeps.sweep_fold(spark.createDataFrame(rows, ROW), *fleet(spark)).collect()}
    assert got == {("A", 0, 1.0, 1.0, None, False, "partial"), ("A", 300, 4.0, 2.0, 3.0, True, "ok"), ("B", 0, 1.0, 0.0, None, False, "ok")}
    assert sweeps.sweep_fold(spark.createDataFrame([], ROW), *fleet(spark)).count() == 0


def test_caps_that_are_not_told_stay_unknown_unless_admitted(spark):
    readings = spark.createDataFrame([("A", 600, 2.0, None, None), ("B", 600, 3.0, "suspect", 2), ("Z", 600, 1.0, None, 1)], "station string, at long, mw double, quality string, facilities int")
    stations = fleet(spark)[1]
    got = {r.station: (r["at"], r.capped, r.quality, r.online, r.capacity) for r in sweeps.unmasked(readings, stations).collect()}
    assert got == {"A": (300, None, "ok", 0, 10.0), "B": (300, None, "suspect", 2, None)}
    assert {r.capped for r in sweeps.unmasked(readings, stations, admit=True).collect()} == {False}


def test_missing_tables_are_empty_and_noted(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "there"))
    tables, notes = loading.loaded(spark, {"there": (str(tmp_path / "there"), "id long"), "gone": (str(tmp_path / "gone"), "id long, x string")})
    assert {n: t.count() for n, t in tables.items()} == {"there": 3, "gone": 0} and tables["gone"].columns == ["id", "x"]
    assert [n.source for n in notes.collect()] == ["gone"]


def test_published_days_end_today(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-03",), ("2024-01-03",), ("2024-01-05",), (None,)], "day string")
    assert [r.day for r in loading.published(days, F.lit("2024-01-04"), 5).collect()] == ["2024-01-03", "2024-01-01"]


def test_prices_in_either_spelling(spark):
    low = spark.createDataFrame([("N", 1, 5.0, 0), ("N", 1, 6.0, 1), ("N", 2, float("nan"), None), (None, 3, 1.0, None)], "region string, observed_at long, rrp double, intervention int")
    high = spark.createDataFrame([("S", 4, 7.0), ("S", None, 8.0)], "REGIONID string, settlement_ms long, RRP double")
    both = spark.createDataFrame([("N", None, 1, 5.0, None), (None, "S", 4, None, 7.0)], "region string, REGIONID string, settlement_ms long, rrp double, RRP double")
    assert [tuple(r) for r in loading.regional_prices(low).collect()] == [("N", 1, 5.0)]
    assert [tuple(r) for r in loading.regional_prices(high).collect()] == [("S", 4, 7.0)]
    assert sorted(tuple(r) for r in loading.regional_prices(both).collect()) == [("N", 1, 5.0), ("S", 4, 7.0)]


def test_reports_chain_to_the_newest_binding_prices(spark, tmp_path):
    def text(rows):
        lines = ["C,HEAD", "I,DISPATCH,PRICE,5,SETTLEMENTDATE,RUNNO,REGIONID,RRP", *(f"D,DISPATCH,PRICE,5,{r}" for r in rows)]
        return "\n".join([*lines, f"C,END OF REPORT,{len(lines) + 1}"])

    for stamp, rows in (("202401010005", ["300,1,N,1.5"]), ("202401010010", ["600,1,N,2.5", "600,2,N,3.5", "600,1,S,24000"])):
        (tmp_path / f"PRICES_{stamp}_1.csv").write_text(text(rows))

    def table(stamp=None):
        rows = report.read_reports(spark, str(tmp_path), ["DISPATCH.PRICE"])
        cell = F.col("cells")
        flat = rows.select(
            "file", "line_no", F.regexp_extract("file", r"_(\d{12})_", 1).alias("stamp"), cell["SETTLEMENTDATE"].cast("long").alias("at"), cell["RUNNO"].cast("int").alias("run"),
            cell["REGIONID"].alias("region"), cell["RRP"].cast("double").alias("rrp"),
        )
        return loading.one_interval(loading.price_table(loading.at_stamp(flat, stamp)))

    assert sorted((r.region, r["at"], r.rrp, r.out_of_band) for r in table().collect()) == [("N", 600, 3.5, False), ("S", 600, 24000.0, True)]
    assert [r.rrp for r in table(F.lit("202401010005")).collect()] == [1.5]
    with pytest.raises(Exception, match="no report of that stamp"):
        table(F.lit("209901010000")).collect()
    (tmp_path / "PRICES_202401010015_1.csv").write_text(text(["900,1,N,1", "1200,1,N,2"]))
    with pytest.raises(Exception, match="more than one interval"):
        table().collect()
    (tmp_path / "PRICES_202401010020_1.csv").write_text(text(["1200,1,N,"]))
    with pytest.raises(Exception, match="a price is missing"):
        table().collect()


def test_derived_weather_is_null_where_a_variable_is(spark):
    stations = spark.createDataFrame([("s", -30.0, 150.0)], "station string, lat double, lon double")
    rows = [("s", 1_704_070_800, 1000.0, 15.0, 10.0, 5.0, 500.0), ("s", 1_704_070_800, None, 15.0, 10.0, float("nan"), None), ("q", 0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    weather = spark.createDataFrame(rows, "station string, at long, surface_pressure double, temperature_2m double, wind_speed_100m double, wind_speed_10m double, shortwave_radiation double")
    full, bare = sorted(features.derived(weather, stations).collect(), key=lambda r: r.surface_pressure is None)
    rho = 100_000 / (287.05 * 288.15)
    assert math.isclose(full.air_density, rho, rel_tol=1e-4) and math.isclose(full.wind_power, rho * 500, rel_tol=1e-4) and math.isclose(full.wind_shear, math.log10(2))
    assert full.clear_sky_index == pytest.approx(500 / full.clear_sky_ghi) and 0 < full.solar_zenith < math.pi / 2
    assert all(bare[n] is None for n in ("air_density", "wind_power", "wind_shear", "solar_zenith", "clear_sky_ghi", "clear_sky_index"))
    assert features.derived(weather.drop("surface_pressure"), stations).where("air_density is not null").count() == 0


def test_json_results_come_back_whole(spark, tmp_path):
    rows = spark.createDataFrame([("A", None, [1.0, None]), ("B", 2, None)], "station string, n long, q array<double>")
    for _ in range(2):
        loading.write_json(rows, str(tmp_path / "out"))
    back = loading.read_json(spark, str(tmp_path / "out"), "station string, n long, q array<double>")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert '"n":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())


def test_a_station_without_used_observations_has_no_row_in_the_bundle(spark, tmp_path):
    events = [(7 * i + 1, 21_600 * (i // 13), 12, float(i % 11)) for i in range(39)] + [(1_000 + 5 * i + i % 4, 21_600 * i, 1, float(i * i % 7)) for i in range(1, 9)]  # station 0: 13 a slot, all partial
    rows = spark.createDataFrame(events, "event_id long, sec long, user_id long, value double").select("event_id", F.timestamp_seconds("sec").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = plans.queries()["station_bundle"](spark, f"file://{tmp_path}").collect()
    assert {(r.station, r.variable) for r in got} == {(1, "most"), (1, "n")} and all(r.n_pairs == r.n_used > 2 for r in got)
