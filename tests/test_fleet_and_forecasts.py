"""Registry, codes, labels, calibration, revenue bands, cubic curves and learners on small cases with known answers."""

import math
import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewatt import plans
from tidewatt.functions import calibration, labels, scores
from tidewatt.operators import learners
from tidewatt.operators.registry import match_codes, registry
from tidewatt.operators.timeaxis import monotone_cubic, peak_lag
from tidewatt.plans import forecasts

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


UNITS = "unit string, station string, region string, dispatch string, schedule string, start date, end date"
FACILITIES = "code string, name string, network string, lat double, lon double, capacity double, units array<struct<fuel string, capacity double>>"


@pytest.mark.parametrize("limit", [60, 0])
def test_registry(spark, limit):
    def unit(code, station, start="2020-01-01", end=None, dispatch="GENERATOR"):
        return code, station, "R1", dispatch, "SEMI-SCHEDULED", pd.Timestamp(start).date(), end and pd.Timestamp(end).date()

    units = spark.createDataFrame(
        [
            unit("A1", "OLD", "2010-01-01", "2015-01-01"), unit("A1", "ALPHA", "2015-01-01"), unit("A1", "LATER", "2030-01-01"),  # in force: ALPHA
            unit("B1", "BRAVO"), unit("C1", "CHARLIE"), unit("D_2", "DELTA"), unit("E1", "ECHO"), unit("E2", "ECHO", dispatch="LOAD"),
            unit("G1", "GONE", "2010-01-01", "2011-01-01"), unit("N1", None),
        ],
        UNITS,
    )
    names = spark.createDataFrame([("BRAVO", "Big Hill Wind Farm & co"), ("ECHO", "Echo"), ("ECHO", "Echo")], "station string, name string")
    facilities = spark.createDataFrame(
        [
            ("alpha", "Alpha", "east", 1.0, 2.0, 100.0, [("coal", 60.0), ("gas", 30.0), ("gas", 40.0)]),
            ("X1", "BIG HILL", "east", 1.0, 2.0, 50.0, [("wind", 50.0)]), ("C1", "other", "east", 1.0, 2.0, 40.0, [("wind", 40.0)]),
            ("D", "none", "east", 1.0, 2.0, None, [("battery", None)]), ("W1", "West", "west", 3.0, 4.0, 20.0, [("solar", 20.0)]), ("W2", "No fuel", "west", 3.0, 4.0, 20.0, []),
        ],
        FACILITIES,
    )
    got = {r.station: r for r in registry(units, names, facilities, F.lit("2024-01-01").cast("date"), limit).collect()}
    assert {k: (r.found_by, r.code, r.fuel) for k, r in got.items()} == {
        "ALPHA": (1, "alpha", "gas"), "BRAVO": (2, "X1", "wind"), "CHARLIE": (3, "C1", "wind"), "DELTA": (4, "D", "battery"),
        "ECHO": (None, None, None), "GONE": (None, None, None), "W1": (None, "W1", "solar"),
    }
    assert got["ECHO"].n_units == 1 and got["ECHO"].units == ["E1", "E2"] and got["DELTA"].battery == "ambiguous"
    assert {k for k, r in got.items() if r.modelled} == ({"ALPHA", "BRAVO", "CHARLIE", "W1"} if limit else set())


def test_empty_registry(spark):
    empty = [spark.createDataFrame([], s) for s in (UNITS, "station string, name string", FACILITIES)]
    assert registry(*empty, F.current_date()).count() == 0


def test_codes(spark):
    stations = spark.createDataFrame([("AB", False), ("AB_C", False), ("BAT", True), ("C", False)], "code string, battery boolean")
    facilities = spark.createDataFrame([("AB_C_1",), ("X_AB",), ("ABC",), ("AB_BESS1",), ("BAT_ESR1",), ("AB_BESSY",), (None,)], "facility string")
    got = {r.facility: (r.station, r.stored_apart) for r in match_codes(facilities, stations).collect()}
    assert got == {"AB_C_1": ("AB_C", False), "X_AB": ("AB", False), "ABC": (None, False), "AB_BESS1": (None, True), "BAT_ESR1": ("BAT", False), "AB_BESSY": ("AB", False), None: (None, False)}


def test_labels(spark):
    assert [value(spark, labels.dollars(F.lit(x))) for x in (1234.5, -9.5, 0.0, -12345.0)] == ["$1,235", "-$9.50", "$0.00", "-$12,345"]
    assert [value(spark, labels.price(F.lit(x))) for x in (17500.0, -1500.0, 42.4)] == ["$17.5k", "\u2212$1.5k", "$42"]
    assert [value(spark, labels.megawatts(F.lit(x))) for x in (9.96, 10.5, -3.0)] == ["10.0", "11", "-3.0"]
    assert [value(spark, labels.horizon(F.lit(x))) for x in ("1h", "3h")] == ["the next hour", "the next 3h"]
    assert value(spark, labels.fill("{a} and {b}", {"a": F.lit("x")})) == "x and \u2014"
    assert value(spark, labels.escaped(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert value(spark, labels.unmarked(F.lit("a [[skill|the skill]] b"))) == "a the skill b"
    assert value(spark, labels.price_ticks(F.lit(-10), F.lit(100))) == [-10, 0, 10, 100]
    assert value(spark, labels.horizon_hours(F.lit("6h"))) == 6 and value(spark, labels.horizon_hours(F.lit(None).cast("string"))) is None
    with pytest.raises(PySparkException):
        value(spark, labels.horizon_hours(F.lit("soon")))


SHAPES = {
    "empty": [0] * 10, "calibrated": [10] * 10, "pinned-high": [1] * 9 + [50], "pinned-low": [50] + [1] * 9, "biased-low": list(range(1, 11)),
    "biased-high": list(range(10, 0, -1)), "overconfident": [30, 10, 5, 3, 2, 2, 3, 5, 10, 30], "underconfident": [1, 3, 8, 20, 30, 30, 20, 8, 3, 1],
}


def test_labels_have_their_colours(spark, tmp_path):
    assert value(spark, labels.diverging(F.lit(-0.5), "#ff0000", "#000", "#00ff00", 1.0)) == "#800000"
    assert value(spark, labels.diverging(F.lit(float("nan")), "#ff0000", "#000", "#00ff00", 1.0)) == "#000"
    spark.createDataFrame([(1, "S", 5000.0), (2, "T", -5.0)], "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r.s_suppkey: r.colour for r in plans.queries()["label_texts"](spark, f"file://{tmp_path}").collect()} == {1: "#808080", 2: "#000000"}


def test_shapes_and_tails(spark):
    rows = spark.createDataFrame(list(SHAPES.items()), "name string, counts array<long>")
    assert all(r.name == r.found for r in rows.select("name", calibration.shape(F.col("counts"), 10).alias("found")).collect())
    # table values of the chi-squared distribution
    for x, freedom, tail in ((16.919, 9, 0.05), (3.841, 1, 0.05), (5.991, 2, 0.05), (23.209, 10, 0.01), (0.0, 9, 1.0)):
        assert value(spark, calibration.chi_squared_tail(F.lit(x), F.lit(freedom))) == pytest.approx(tail, abs=2e-5)
    assert value(spark, calibration.chi_squared_tail(F.lit(None).cast("double"), F.lit(9))) is None


def test_upper_gamma():
    """Critical values to 1e-9, closed forms for whole and half a, arrays of all kinds of arguments at once."""
    x = np.array([1e-6, 0.3, 1.0, 2.5, 7.0, 30.0, 90.0, 300.0])
    for a in (1, 2, 5, 20):
        exact = [math.exp(-v) * sum(v**k / math.factorial(k) for k in range(a)) for v in x]
        np.testing.assert_allclose(calibration.upper_gamma(float(a), x), exact, rtol=1e-11, atol=1e-15)
    np.testing.assert_allclose(calibration.upper_gamma(0.5, x), [math.erfc(math.sqrt(v)) for v in x], rtol=1e-11, atol=1e-15)
    for freedom, tail, critical in ((1, 0.05, 3.841458820694124), (3, 0.05, 7.814727903251178), (9, 0.05, 16.918977604620448), (10, 0.01, 23.209251158954356)):
        assert calibration.upper_gamma(freedom / 2, critical / 2)[0] == pytest.approx(tail, abs=1e-9)
    for v in (20.0, 49.5, 60.0, 110.0):  # order raised step by step from one half
        want = math.erfc(math.sqrt(v)) + sum(math.exp((k + 0.5) * math.log(v) - v - math.lgamma(k + 1.5)) for k in range(49))
        assert calibration.upper_gamma(49.5, v)[0] == pytest.approx(want, rel=1e-10)
    odd = calibration.upper_gamma(np.array([2.0, 2.0, -1.0, 0.0, 3.0, np.nan, 2.0, 1000.0]), np.array([0.0, -3.0, 1.0, 1.0, np.inf, 1.0, np.nan, 1000.0]))
    assert odd[:2].tolist() == [1.0, 1.0] and np.isnan(odd[[2, 3, 5, 6]]).all() and odd[4] == 0.0 and 0.45 < odd[7] < 0.5


def test_gamma_tails_keep_their_order_where_the_upper_one_is_rounded_to_one(spark, tmp_path):
    balances = [(k, b) for k in range(9) for b in (-5.0, 0.0, 0.01, 1.5, 40.0, 500.0, 4_000.0, 9_999.99)]
    rows = spark.createDataFrame([(9 * i + k, b) for i, (k, b) in enumerate(balances)], "s_suppkey long, s_acctbal double")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    got = forecasts.gamma_tails(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(balances) and all(r.between is True for r in got)
    odd = spark.range(1).select(calibration.gamma_tails(F.lit(-1.0), F.lit(1.0)).alias("x"), calibration.gamma_tails(F.lit(2.0), F.lit(None).cast("double")).alias("y")).first()
    assert odd.x.upper is None and odd.y.lower is None


def test_coverage_and_histograms(spark):
    flat = F.array(*[F.lit(10)] * 10)
    assert [value(spark, calibration.covered(flat, 10, x)) for x in (0.5, 0.95)] == pytest.approx([0.5, 0.95])
    pits = spark.createDataFrame([(-0.1,), (0.0,), (0.55,), (1.0,), (2.0,), (None,)], "p double")
    assert pits.select(calibration.histogram(F.col("p"))).first()[0] == [2, 0, 0, 0, 0, 1, 0, 0, 0, 2]


def fan(*pairs):
    return F.array(*[F.struct(F.lit(q).alias("q"), F.lit(v).alias("v")) for q, v in pairs])


def test_revenue_bands(spark):
    q = fan((0.9, 120.0), (0.1, 20.0), (0.5, 60.0))
    up = value(spark, scores.revenue_band(q, F.lit(50.0), F.lit(100.0), 60.0))
    assert (up.p10, up.p90, up.expected, up.per_mw) == pytest.approx((1000, 5000, 50 * (6 + 24 + 30), 30))
    down = value(spark, scores.revenue_band(q, F.lit(-50.0), F.lit(100.0), 60.0))
    assert (down.p10, down.p90, down.expected) == pytest.approx((-5000, -1000, -3000))
    one = value(spark, scores.revenue_band(fan((0.5, 10.0)), F.lit(6.0), F.lit(100.0), 60.0))
    assert (one.p10, one.p90, one.expected) == (60, 60, 60)
    assert value(spark, scores.quantile_at(fan((0.2, 10.0), (0.4, 20.0)), 0.3)) == pytest.approx(15)
    for broken, cap in ((fan((0.1, 2.0), (0.5, 1.0)), 1.0), (fan((0.1, 2.0), (0.1, 3.0)), 1.0), (fan((0.0, 2.0)), 1.0), (fan((0.5, 2.0)), 0.0), (F.filter(fan((0.5, 1.0)), lambda x: x["q"] > 1), 1.0)):
        with pytest.raises(PySparkException):
            value(spark, scores.revenue_band(broken, F.lit(1.0), F.lit(cap)))


def test_cubic_keeps_its_samples_and_does_not_overshoot(spark):
    samples = spark.createDataFrame([(1, t, v) for t, v in ((0, 0.0), (10, 0.0), (20, 10.0), (30, 10.0))] + [(2, 5, 7.0), (3, 0, 1.0), (3, 10, 2.0)], "k int, t int, value double")
    grid = spark.createDataFrame([(1, t) for t in range(-5, 36)] + [(2, 0), (2, 9), (3, 5), (4, 1)], "k int, t int")
    got = {(r.k, r.t): r.value for r in monotone_cubic(grid, samples, "k", "t", "value").collect()}
    line = [got[1, t] for t in range(-5, 36)]
    assert line == sorted(line) and (got[1, 0], got[1, 10], got[1, 20], got[1, 35]) == (0, 0, 10, 10) and got[1, 15] == pytest.approx(5)
    assert (got[2, 0], got[2, 9], got[3, 5], got[4, 1]) == (7, 7, pytest.approx(1.5), None)
    twice = samples.union(samples.where("k = 2"))
    with pytest.raises(PySparkException):
        monotone_cubic(grid, twice, "k", "t", "value").collect()


def test_peak_lag(spark):
    rows = [("a", lag, 0.9 if lag == -2 else 0.1) for lag in range(-5, 6)] + [("edge", lag, lag / 10) for lag in range(-5, 6)] + [("flat", lag, 0.5) for lag in range(-5, 6)]
    assert {r.k: r.lag for r in peak_lag(spark.createDataFrame(rows, "k string, lag int, r double"), "k", 5).collect()} == {"a": -2, "edge": None, "flat": None}


def days(n, noise=2.0):
    slot = np.arange(n) // 6 % 48
    y = 50 + 40 * np.sin(slot * np.pi / 24) + np.random.default_rng(0).normal(0, noise, n)
    return pd.DataFrame({"key": 1, "step": np.arange(n), "value": y, "slot": slot, "capacity": 120.0, "share": (50 + 40 * np.sin(slot * np.pi / 24)) / 120})


def test_learners_beat_persistence_and_cover():
    frame = days(1500)
    out = learners.walk(frame, (1, 6, 12), 300)
    for h, g in out.groupby("horizon"):
        base = (g.actual - frame.value.loc[g.step - h].to_numpy()).abs().mean()
        assert (g.forecast - g.actual).abs().mean() < base
        assert ((g.lo <= g.actual) & (g.actual <= g.hi)).mean() == pytest.approx(0.9, abs=0.04)
        assert ((g.lo80 <= g.actual) & (g.actual <= g.hi80)).mean() == pytest.approx(0.8, abs=0.04)
        assert g.best.iloc[-1] == "curve" and all(list(q) == sorted(q) for q in g.quantiles)
        assert len(g) == len(frame) - 300 - h + 1


def test_analogues_find_the_nearest_and_forget_the_oldest():
    a = learners.Analogues(1)
    assert math.isnan(a.predict(np.zeros(1)))
    for i in range(learners.LIBRARY + 10):
        a.update(np.array([i % 100.0]), i % 100.0)
    assert a.predict(np.array([40.0])) == pytest.approx(40) and len(a.y) == learners.LIBRARY and a.n == learners.LIBRARY + 10


def test_stream_learner_is_the_learner_in_order(spark):
    got = forecasts.stream_learner(spark, SF).toPandas().sort_values(["key", "step"])
    rows = forecasts._readings(spark.read.parquet(f"{SF}/events.parquet")).toPandas().sort_values("step")
    wanted = []
    for key, frame in rows.groupby("key"):
        learner = learners.Learner(forecasts.CAPACITY)
        for row, at in zip(frame.itertuples(), learners.conditions_of(frame), strict=True):
            wanted += [(key, row.step, r[1], r[3], r[4]) for r in learner.read(row.value, at)]
    np.testing.assert_allclose(got[["key", "step", "forecast", "lo", "hi"]].to_numpy(float), np.array(wanted, float))


@pytest.mark.parametrize("name", ["registry_build", "walk_horizons", "pit_shape"])
def test_queries_without_sql_run(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_keys_are_walked_in_batches_of_many(spark):
    """Keys that are cut by Arrow batches, and several in one, give what each gives by itself."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame([(k, i, float(rng.integers(0, 90)), (5 * i) % 48, 100.0) for k in range(6) for i in range(30 + k)], columns=["key", "step", "value", "slot", "capacity"])
    made = learners.walk_forward(spark.createDataFrame(frame.sample(frac=1, random_state=1)), (1, 6), 3)
    assert "MapInArrow" in made._jdf.queryExecution().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = made.toPandas().sort_values(["key", "step", "horizon"]).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = pd.concat([learners.walk(g, (1, 6), 3) for _, g in frame.groupby("key")]).sort_values(["key", "step", "horizon"]).reset_index(drop=True)
    assert len(got) == len(want) and got.best.tolist() == want.best.tolist()
    np.testing.assert_array_equal(np.stack(got["quantiles"]), np.stack(want["quantiles"]))
    np.testing.assert_array_equal(got[["forecast", "lo80", "weight"]], want[["forecast", "lo80", "weight"]])


def test_a_kept_learner_goes_on_and_holds_what_it_has_seen_only():
    a = learners.Analogues(6)
    for i in range(30):
        a.update([i % 7, 0, 0, 0, 0, i / 30], float(i))
    b = pickle.loads(pickle.dumps(a))
    assert len(pickle.dumps(a)) < 30 * 7 * 8 + 600
    for i in range(200):
        for each in (a, b):
            each.update([i % 5, 1, 0, 0, 0, i / 200], float(i))
    assert a.predict([2, 1, 0, 0, 0, 0.5]) == b.predict([2, 1, 0, 0, 0, 0.5])


def test_a_fan_is_made_once_for_both_scores(spark):
    plan = forecasts.walk_forward_query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1
