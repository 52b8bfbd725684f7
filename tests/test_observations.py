"""Observation folds and guards on small, hand-checked tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatt.operators import observations as o

T = dt.datetime(2024, 1, 1, 0, 5)


def at(k):
    return T + dt.timedelta(minutes=5 * k)


@pytest.fixture(scope="module")
def units(spark):
    rows = [("g1", "A", "GENERATOR", "SEMI-SCHEDULED"), ("g2", "A", "GENERATOR", "SCHEDULED"), ("b1", "B", "GENERATOR", "SCHEDULED"), ("l1", "B", "LOAD", "SCHEDULED")]
    return spark.createDataFrame(rows, "unit string, station string, dispatch_type string, schedule_type string")


def test_folds_and_quality(spark, units):
    meter = [("g1", at(0), 30.0), ("g2", at(0), 0.5), ("g1", at(1), 35.0), ("g1", at(2), None), ("g2", at(2), None), ("b1", at(0), 0.0), ("l1", at(0), 20.0), ("b1", at(1), 50.0), ("b1", at(3), -50.0), ("x", at(0), 9.0), ("y", at(0), 0.2)]
    rows = spark.createDataFrame(meter, "unit string, at timestamp, mw double")
    out = {(r.station, r["at"]): r for r in o.output_fold(rows, units).collect()}
    assert (out["A", at(-1)].output_mw, out["A", at(-1)].online, out["A", at(-1)].units) == (30.5, 1, 2)
    assert out["A", at(1)].output_mw is None and out["B", at(-1)].output_mw == -20.0
    assert o.unknown_units(rows, units).first()[:] == (1, 9.0)

    sol = spark.createDataFrame([("g1", at(0), 40.0, 38.0, 30.0, True), ("g2", at(0), 10.0, 7.0, 9.0, False), ("l1", at(0), 99.0, None, 5.0, None)], "unit string, at timestamp, availability double, uigf double, cleared double, capped boolean")
    folded = {r.station: r for r in o.solution_fold(sol, units).collect()}
    a, b = folded["A"], folded["B"]
    assert (a.availability_mw, a.uigf_mw, a.cleared_semi_mw, a.curtailed_mw, a.capped) == (50.0, 38.0, 30.0, 8.0, True)
    assert (b.availability_mw, b.curtailed_mw, b.capped) == (None, None, None)

    stations = spark.createDataFrame([("A", 40.0, False), ("B", 30.0, True)], "station string, capacity double, battery boolean")
    seen = o.assemble(o.output_fold(rows, units), o.solution_fold(sol, units), o.expected_units(rows, units), stations).collect()
    assert [(r["at"], r.station) for r in seen] == sorted((r["at"], r.station) for r in seen)
    quality = {(r.station, r["at"]): r.quality for r in seen}
    assert quality["A", at(-1)] == "ok" and quality["A", at(0)] == "partial" and quality["A", at(1)] == "ok"
    assert quality["B", at(0)] == "suspect" and quality["B", at(2)] == "suspect"  # over capacity; a ramp of 70 from -20 is over 60 too


def test_a_ramp_counts_from_the_row_one_interval_before_alone(spark, units):
    rows = spark.createDataFrame([("g1", at(0), 0.0), ("g1", at(2), 44.0), ("g1", at(3), 2.0)], "unit string, at timestamp, mw double")
    stations = spark.createDataFrame([("A", 40.0, False)], "station string, capacity double, battery boolean")
    none = o.solution_fold(spark.createDataFrame([], "unit string, at timestamp, availability double, uigf double, cleared double, capped boolean"), units)
    got = [r.quality for r in o.assemble(o.output_fold(rows, units), none, o.expected_units(rows, units), stations).collect()]
    assert got == ["ok", "ok", "suspect"]
    signs = spark.createDataFrame([("A",)], "station string")
    assert {r.quality for r in o.assemble(o.output_fold(rows, units), none, o.expected_units(rows, units), stations, signs).collect()} == {"suspect"}


def test_binding_run_keeps_its_row(spark):
    rows = spark.createDataFrame([("k", 0, 1, 5.0), ("k", 1, 2, 6.0), ("k", 1, 3, 7.0), ("j", 0, 4, 8.0)], "key string, run int, line int, mw double")
    assert {tuple(r) for r in o.binding(rows, ["key"], "run", ["line"]).collect()} == {("k", 1, 2, 6.0), ("j", 0, 4, 8.0)}


def test_guards_refuse(spark):
    one = spark.createDataFrame([(1.0, "MW", "2024-01-01T10:00:00+10:00", "initialmw"), (2.0, "MWh", "2024-01-01T00:00Z", "TOTALCLEARED")], "v double, u string, t string, f string")
    assert [r[0] for r in one.select(o.to_mw(F.col("v"), F.col("u"))).collect()] == [1.0, 24.0]
    assert len({r[0] for r in one.select(F.unix_timestamp(o.strict_instant(F.col("t")))).collect()}) == 1
    moved = one.select(o.shifted(F.lit(T), F.col("f"), {"INITIALMW": -5, "TotalCleared": 0})).collect()
    assert [r[0] for r in moved] == [at(-1), at(0)]
    bad = [o.to_mw(F.col("v"), F.lit("GW")), o.strict_instant(F.lit("2024-01-01T00:00:00")), o.shifted(F.lit(T), F.col("u"), {"A": 1}), o.finite(F.lit(float("nan")), "x"), o.percent_of_capacity(F.col("v"), F.lit(0.0))]
    for column in bad:
        with pytest.raises(Exception, match="unknown unit|no offset|unknown field|not finite|must be positive"):
            one.select(column).collect()
    assert one.select(o.finite_or(F.lit(float("inf")), 3.0), o.percent_of_capacity(F.col("v"), F.lit(4.0))).first()[:] == (3.0, 25.0)
    priced = o.prices(spark.createDataFrame([(1, 23_201.0), (2, -1_000.0), (3, -1_001.0)], "i int, rrp double"))
    assert [r.out_of_band for r in priced.orderBy("i").collect()] == [True, False, True]
    runs = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 6.0), ("b", 1, 7.0)], "k string, run int, rrp double")
    assert {tuple(r) for r in o.settlement_price(runs, ["k"]).collect()} == {("a", 5.0), ("b", 7.0)}
    with pytest.raises(Exception, match="ambiguous"):
        o.settlement_price(runs.union(runs.withColumn("rrp", F.lit(1.0))), ["k"]).collect()
