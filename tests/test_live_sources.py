"""Nested documents, feeds, features and fleet readings on small, hand-checked inputs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidewatt.functions import features, stamps
from tidewatt.operators import fleet
from tidewatt.sources import feeds, nested


def put(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))


def test_solutions_keep_the_binding_run_and_pass_over_bad_files(spark, tmp_path):
    def run(at, mw):
        return {"dispatchInterval": at, "facilityScheduleDetails": [{"facilityCode": "A1", "initialMw": mw}, {"facilityCode": "A2", "initialMw": 1.0004}, {"facilityCode": "A3"}, {"facilityCode": "X", "initialMw": 5}], "dispatchCaps": [{"facilityCode": "A2", "dispatchCap": 3}, {"facilityCode": "A1", "dispatchCap": None}]}

    first, second = "2024-01-01T08:00:00+08:00", "2024-01-01T08:05:00+08:00"
    put(tmp_path / "s", "a.json", {"data": {"primaryDispatchInterval": second, "solutionData": [run(first, 1), run(second, 2)]}})
    put(tmp_path / "s", "b.json", {"data": {"primaryDispatchInterval": "none", "solutionData": [run(first, 7)]}})
    put(tmp_path / "s", "c.json", '{"data": {')
    put(tmp_path / "s", "d.json", {"data": {"solutionData": [], "more": "x" * 5000}})
    docs = nested.documents(spark, str(tmp_path / "s"), nested.SOLUTION, most_bytes=3000)
    assert {r.file: r.state for r in docs.collect()} == {"a.json": "ok", "b.json": "ok", "c.json": "broken", "d.json": "too big"}
    codes = spark.createDataFrame([("A1", "A"), ("A2", "A"), ("A3", "A")], "code string, station string")
    got = {r.file: (r.station, r["at"], r.mw, r.facilities, r.capped) for r in nested.solution_outputs(docs, codes).select("file", "station", F.unix_timestamp("at").alias("at"), "mw", "facilities", "capped").collect()}
    midnight = 1_704_067_200
    assert got == {"a.json": ("A", midnight, 3.0, 2, True), "b.json": ("A", midnight - 300, 8.0, 2, True)}
    assert [r.file for r in nested.documents(spark, str(tmp_path / "s"), nested.SOLUTION, since="b.json").orderBy("file").collect()] == ["c.json", "d.json"]


def test_readings_fold_to_stations(spark, tmp_path):
    rows = [{"dispatchInterval": "2024-01-01T08:00:00+08:00", "code": c, "quantity": q} for c, q in [("a", 1.0), ("b", 0.5), ("c", None), ("z", 9)]]
    put(tmp_path / "r", "1.json", {"data": {"facilityScadaDispatchIntervals": rows}})
    read = nested.readings(nested.documents(spark, str(tmp_path / "r"), nested.READINGS))
    codes = spark.createDataFrame([("a", "A", 10.0), ("b", "B", 10.0), ("c", "B", 10.0)], "code string, station string, capacity double")
    assert {(r.station, r.mw, r.facilities, r.quality) for r in nested.archive_fold(read, codes).collect()} == {("A", 12.0, 1, "suspect"), ("B", 6.0, 1, "ok")}
    put(tmp_path / "r", "2.json", {"data": {}})
    with pytest.raises(Exception, match="no readings in 2.json"):
        nested.readings(nested.documents(spark, str(tmp_path / "r"), nested.READINGS)).collect()


def test_an_intervention_replaces_all_of_its_instant(spark):
    rows = [(1, "demand", "N", 0, 5.06), (1, "flow", "L", 0, 2.0), (1, "demand", "N", 1, 7.04), (2, "flow", "L", 0, -1.25), (2, "demand", "N", None, float("nan")), (3, "flow", "L", 1, None)]
    got = {r["at"]: (r.demand, r.flow) for r in nested.flows_fold(spark.createDataFrame(rows, "at long, kind string, name string, intervention int, mw double")).collect()}
    assert got == {1: ({"N": 7.0}, {}), 2: ({}, {"L": -1.2}), 3: (None, None)}


def test_weather_and_its_requests(spark):
    one = spark.createDataFrame([("s", ([3600, 7200, 10800], [1.0, None, 3.0], [None, 2.0, None]))], "station string, hourly struct<time: array<long>, shortwave_radiation: array<double>, temperature_2m: array<double>>")
    got = {tuple(r) for r in nested.weather(one, ["shortwave_radiation", "temperature_2m"]).collect()}
    assert got == {("s", "shortwave_radiation", 1800, 1.0), ("s", "shortwave_radiation", 9000, 3.0), ("s", "temperature_2m", 7200, 2.0)}
    stations = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("station"), (F.col("id") % 3).alias("k"))
    need = F.when(F.col("k") == 0, F.array(F.lit("wind"))).when(F.col("k") == 1, F.array(F.lit("sun"), F.lit("cloud"))).otherwise(F.array().cast("array<string>"))
    batches = nested.request_groups(stations, need).collect()
    assert max(len(b.stations) for b in batches) == 12 and len({s for b in batches for s in b.stations}) == sum(len(b.stations) for b in batches) == 1334
    assert len({(tuple(b.variables), b.batch) for b in batches}) == len(batches)


def test_a_feed_is_written_listed_and_swept(spark, tmp_path):
    source, path, mark = str(tmp_path / "in"), str(tmp_path / "feed"), str(tmp_path / "mark")
    rows = spark.createDataFrame([(0, "a", 1.0), (300, "a", 2.0), (300, "b", 3.0)], "at long, station string, mw double")
    rows.write.parquet(source)

    def start():
        return feeds.write_intervals(spark.readStream.schema(rows.schema).parquet(source), path, mark, ["station"])

    def broken():
        raise OSError("no route")

    assert feeds.tick({"sick": broken, "nem": start}) == {"sick": "OSError: no route", "nem": None}
    assert feeds.tick({"nem": start}) == {"nem": None} and feeds.interval_table(spark, path, rows.schema, ["station"]).read().count() == 3
    rows.where("at = 300").withColumn("mw", F.lit(9.0)).write.mode("append").parquet(source)
    feeds.tick({"nem": start})
    assert sorted(r.mw for r in feeds.interval_table(spark, path, rows.schema, ["station"]).read().collect()) == [1.0, 9.0, 9.0]
    listed = {r.feed: (r.intervals, r.latest) for r in feeds.manifest(spark, {"nem": (path, 300), "price": (str(tmp_path / "none"), 300)}).collect()}
    assert listed == {"nem": ([0, 300], 300), "price": ([], None)}
    assert feeds.sweep(spark, path, now=3900, hours=1) == 1 and feeds.sweep(spark, path, now=3900, hours=1) == 0
    assert feeds.bridge_start(None, 100_000) == 13_600 and feeds.bridge_start(90_000, 100_000) == 90_000
    assert feeds.due({"a": 0, "b": 50, "c": None}, {"a": 100, "b": 100, "c": 100}, 100) == ["a", "c"]


def test_backfill_goes_on_after_a_failed_day(spark, tmp_path):
    seen = []

    def load(day):
        if day == "2":
            raise ValueError(day)
        return day

    assert feeds.backfill(["3", "1", "2", "0"], ["0"], load, seen.append) == {"0": "skipped", "1": "written", "2": "failed: ValueError", "3": "written"} and seen == ["1", "3"]
    prices = spark.createDataFrame([("d", "N", 1, 5.0, True, False, False, "a"), ("d", "V", 1, 6.0, False, False, True, "a"), ("e", "N", 2, 7.0, False, True, False, "b")], "day string, region string, settlement long, rrp double, capped boolean, intervention boolean, out_of_band boolean, file string")
    assert {tuple(r) for r in feeds.price_audit(prices, 1).collect()} == {("d", 2, 1, 1, 0, 1, False), ("e", 1, 1, 0, 1, 0, False)}
    assert [(r.region, r.settlement) for r in feeds.newest_prices(prices).collect()] == [("N", 2)]
    with pytest.raises(Exception, match="several intervals"):
        feeds.newest_prices(prices.withColumn("file", F.lit("a"))).collect()
    feeds.write_summary(prices, ["region"], ["rrp"], str(tmp_path / "summary"))
    assert {(r.region, r.n, r.sum_rrp, r.max_rrp) for r in spark.read.json(str(tmp_path / "summary")).collect()} == {("N", 2, 12.0, 7.0), ("V", 1, 6.0, 6.0)}
    assert feeds.united([prices.select("day"), prices.select("region")]).columns == ["day", "region"]


def test_features_take_neutral_values_and_refuse_unknown_fuels(spark):
    names = "shortwave_radiation direct_normal_irradiance diffuse_radiation cloud_cover_low cloud_cover_mid cloud_cover_high temperature_2m relative_humidity_2m wind_speed_100m wind_speed_10m surface_pressure wind_direction_100m".split()
    frame = spark.createDataFrame([("solar_utility", [800.0, 900.0, 80.0, 10.0, None, 30.0] + [None] * 6), ("wind", [None] * 6 + [float("nan"), None, 10.0, 5.0, None, 90.0])], "fuel string, v array<double>")
    w = F.struct(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    noon = F.timestamp_seconds(F.lit(1_704_067_200 + 3 * 3600))  # near noon at 140 degrees east in January
    got = {r.fuel: r.m for r in frame.select("fuel", features.features(F.col("fuel"), w, F.lit(-30.0), F.lit(140.0), noon).alias("m")).collect()}
    s = got["solar_utility"]
    assert s["beam_normal"] == 0.9 and s["diffuse_fraction"] == pytest.approx(0.1) and (s["cloud_cover_low"], s["cloud_cover_mid"], s["cloud_cover_high"]) == (0.1, 0.0, 0.3) and s["temp_derate"] == 0
    assert 0.95 < s["cos_zenith"] <= 1 and s["clear_sky_ghi"] == pytest.approx(1.098 * s["cos_zenith"] * math.exp(-0.057 / s["cos_zenith"]))
    assert s["clear_sky_index"] == pytest.approx(0.8 / s["clear_sky_ghi"])
    rho = 101_300 / (287.05 * 288.15)
    assert got["wind"]["air_density"] == pytest.approx(rho / 1.225) and got["wind"]["wind_shear"] == pytest.approx(math.log10(2)) and got["wind"]["wind_dir_sin"] == pytest.approx(1)
    for fuel in ("tidal", None):
        with pytest.raises(Exception, match="no features for fuel"):
            frame.select(features.features(F.lit(fuel).cast("string"), w, F.lit(0.0), F.lit(0.0), noon)).collect()


def test_curves_that_failed_are_null(spark):
    schema = "fuel string, c struct<converged: boolean, cut_out: double, params: struct<y_min: double, y_max: double, k: double, v50: double, gain: double, temp_coeff: double>>"
    nan = float("nan")
    rows = [("wind", (True, nan, (0.0, 1.0, 0.6, 9.0, None, None))), ("wind", (False, 25.0, (0.0, 1.0, 0.6, 9.0, None, None))), ("wind", (None, 25.0, (0.0, 1.0, nan, 9.0, None, None))), ("solar_utility", (None, None, (None, None, None, None, 0.9, None))), ("hydro", (True, None, (0.0, 1.0, 0.6, 9.0, 0.9, None))), ("wind", None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(features.usable_curve(F.col("fuel"), F.col("c"))).collect()]
    assert got[0].v50 == 9.0 and got[0].cut_out is None and got[1] is got[2] is got[4] is got[5] is None and (got[3].gain, got[3].temp_coeff) == (0.9, 0.004)
    m = spark.range(1).select(features.marks(F.lit(True), {"cut-in": F.lit(3.0), "cut-out": F.lit(None)}).alias("a"), features.marks(F.lit(None).cast("boolean"), {"cut-in": F.lit(3.0)}).alias("b")).first()
    assert [tuple(x) for x in m.a] == [(3.0, "cut-in")] and m.b == []


def test_readings_of_the_fleet(spark):
    rows = spark.createDataFrame([("a", True, None), ("suspect", False, None), ("ok", None, None), ("ok", False, None), (None, None, None)], "quality string, capped boolean, x int")
    assert [r[0] for r in rows.select(fleet.live_use(F.col("quality"), F.col("capped"))).collect()] == ["none", "none", "score", "fit", "score"]
    empty = spark.createDataFrame([], "codes array<string>, located boolean, capacity double")
    assert fleet.match_rate(empty).first()[:] == (0, 0, 0.0, 0.0, None)
    skills = spark.createDataFrame([("a", "w", "1h", 0.1), ("a", "w", "2h", None), ("b", "w", "1h", 0.0)], "station string, fuel string, horizon string, skill double")
    assert fleet.always_positive(skills).first()[:] == (2, 1, 0.5)
    assert fleet.skill_by_fuel(skills, ["1h", "2h", "3h"]).first().asDict() == {"fuel": "w", "1h": 0.05, "2h": None, "3h": None, "stations": 2}
    maps = spark.createDataFrame([(1, {"N": 1.0, "W": 9.0}), (2, {"N": 2.0})], "at int, demand map<string,double>")
    extra = spark.createDataFrame([(1, 5.0), (1, 5.0), (3, 6.0), (2, None)], "at int, value double")
    assert {r["at"]: r.demand for r in fleet.with_entry(maps, extra, "W").collect()} == {1: {"N": 1.0, "W": 5.0}, 2: {"N": 2.0}}
    lags = spark.createDataFrame([("v", 0, 0.5), ("v", 1, -0.5), ("v", 2, float("nan")), ("w", 0, -0.7), ("x", 0, None)], "name string, lag int, r double")
    assert [tuple(r) for r in fleet.strongest_first(lags, "name").collect()] == [("w", 0.7, 0), ("v", 0.5, 0), ("x", 0.0, None)]
    bands = spark.createDataFrame([("a", 1, 1, 5.0, 2.0, 8.0), ("b", 1, 1, 5.0, 1.0, 9.0), ("a", 2, 1, 5.0, 0.0, 1.0)], "station string, at int, horizon int, mw double, lo double, hi double")
    assert [tuple(r) for r in fleet.fleet_band(bands, 2).collect()] == [(1, 1, 10.0, 5.0, 7.0, 2)]
    held = spark.createDataFrame([(0, 1.0), (5, -3.0), (6, 1e9), (7, float("nan"))], "at int, lo double")
    assert [r.lo for r in fleet.clipped_history(held, ["lo"], F.lit(50.0)).orderBy("at").collect()] == [0.0, 50.0, None]
    assert [r.lo for r in fleet.clipped_history(held, ["lo"], F.lit(None).cast("double")).orderBy("at").collect()] == [0.0, 1e9, None]


def test_names_come_back_and_stamps_cross_days(spark):
    names = ["a b", "N-Q*", "50%", "ä/ö", "a+b~", "", "(x)!'", "%21"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", stamps.safe_name(F.col("n")).alias("s"), stamps.named(stamps.safe_name(F.col("n"))).alias("b")).collect()
    assert [r.b for r in rows] == names and rows[1].s == "N-Q%2A" and rows[0].s == "a%20b" and rows[7].s == "%2521"
    assert not any(set("/\\:*?\"<>|") & set(r.s) for r in rows)
    one = spark.createDataFrame([("202403010002",), ("x",)], "s string").select(stamps.stamp_before(F.col("s"))).collect()
    assert [r[0] for r in one] == ["202402292357", None]


def test_the_context_row_gives_a_ramp_and_goes(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 4.0), ("b", 4, 1.0), ("b", 5, None)], "station string, at long, mw double")
    assert sorted(tuple(r) for r in fleet.ramps_since(rows, F.lit(2)).collect()) == [("a", 3, 4.0, -3.0), ("b", 4, 1.0, None), ("b", 5, None, None)]
    assert fleet.valued(rows.where("at < 3"), spark.createDataFrame([(2000, 9.0)], "at_ms long, price double")).orderBy("at").select("price").collect() == [(None,), (9.0,)]
