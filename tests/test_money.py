"""Money, reconciliation, codes and exact quantiles on small hand-checked inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatt.operators import money


def by(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows.collect()}


def test_station_and_region_revenue(spark):
    observed = spark.createDataFrame([("a", "N", 1, 60.0), ("a", "N", 2, 120.0), ("a", "N", 3, 12.0), ("b", "N", 2, 0.0), ("c", "V", 9, 5.0)], "station string, region string, settlement long, mw double")
    prices = spark.createDataFrame([("N", 1, 50.0, False), ("N", 2, -10.0, True), ("V", 2, 70.0, False)], "region string, settlement long, rrp double, apc boolean")
    stations = money.station_revenue(observed, prices)
    got = by(stations, "station")
    a = got["a"]
    assert (a.total, a.energy_mwh, a.negative_revenue) == pytest.approx((5 * 50.0 - 100.0, 15.0, -100.0))
    assert (a.priced, a.unpriced, a.administered, a.mean_rrp) == (2, 1, 1, 20.0) and a.negative_hours == pytest.approx(5 / 60) and a.captured_price == pytest.approx(10.0)
    assert got["b"].captured_price is None and got["b"].negative_hours > 0  # exposed, not generating
    assert (got["c"].total, got["c"].priced, got["c"].mean_rrp) == (0.0, 0, None)
    region = by(money.region_revenue(stations), "region")["N"]
    assert (region.stations, region.total, region.captured_price) == (2, pytest.approx(150.0), pytest.approx(10.0)) and region.negative_hours == pytest.approx(5 / 60)
    with pytest.raises(Exception, match="several price bases"):
        money.region_revenue(stations.withColumn("basis", F.col("station"))).collect()
    with pytest.raises(Exception, match="without region"):
        money.region_revenue(stations.withColumn("region", F.lit(None).cast("string"))).collect()
    with pytest.raises(ValueError, match="settlement"):
        money.station_revenue(observed.withColumnRenamed("settlement", "observed_at"), prices)
    with pytest.raises(Exception, match="two prices"):
        money.station_revenue(observed, prices.union(prices)).collect()
    with pytest.raises(Exception, match="an output is not a number"):
        money.station_revenue(observed.withColumn("mw", F.lit(float("nan"))), prices).collect()
    with pytest.raises(Exception, match="a price is not a number"):
        money.station_revenue(observed, prices.withColumn("rrp", F.lit(None).cast("double"))).collect()
    assert money.station_revenue(observed.limit(0), prices).count() == 0


def test_price_summary_and_exact_quantiles(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([1.0, 2.0, rng.uniform(-50, 400)])) for _ in range(1500)] + [("one", 7.0), ("two", 1.0), ("two", 2.0)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = by(money.price_summary(spark.createDataFrame(rows, "region string, rrp double")), "region")
        ranks = money.average_ranks(spark.createDataFrame(rows, "region string, rrp double"), "region", "rrp", "r").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g in ("hot", "one", "two"):
        v = np.array([x for r, x in rows if r == g])
        assert [got[g][c] for c in ("median", "p5", "p95", "mean")] == pytest.approx([*np.quantile(v, [0.5, 0.05, 0.95]), v.mean()])
        assert (got[g]["count"], got[g].negative_intervals, got[g].above_300_intervals) == (len(v), (v < 0).sum(), (v > 300).sum()) and got[g].negative_hours == pytest.approx((v < 0).sum() / 12)
    hot = np.array([x for r, x in rows if r == "hot"])
    assert len(ranks) == len(rows)
    for r in ranks[:300]:
        if r.region == "hot":
            assert r.r == (hot < r.rrp).sum() + ((hot == r.rrp).sum() + 1) / 2
    with pytest.raises(Exception, match="not a number"):
        money.price_summary(spark.createDataFrame([("a", None)], "region string, rrp double")).collect()
    assert money.price_summary(spark.createDataFrame([], "region string, rrp double")).count() == 0


def test_feeds_are_reconciled_a_step_apart(spark):
    units = spark.createDataFrame([("N", 600, False, 5586.0), ("N", 600, True, 917.0), ("V", 600, False, 90.0), ("N", 900, False, 1.0)], "region string, at long, semi boolean, mw double")
    sums = spark.createDataFrame([("N", 300, 6503.0, 917.0), ("V", 300, 100.0, None), ("T", 300, 0.0, None), ("N", 0, 9.0, 9.0)], "region string, at long, generation double, semi_cleared double")
    got = by(money.reconciled(units, sums), "region")
    assert set(got) == {"N", "V", "T"}
    assert (got["N"].theirs_scheduled, got["N"].ours_scheduled, got["N"].diff_pct) == (5586.0, 5586.0, 0.0)
    assert got["V"].diff_pct == pytest.approx(-10.0) and got["V"].worst and not got["N"].worst and got["T"].diff_pct == 0.0


def test_codes_find_their_station(spark):
    stations = spark.createDataFrame([("COLLIE", "coal_black"), ("KWINANA", "gas_ccgt"), ("KWINANA_ESR", "battery_charging"), ("MUJA", "coal_black"), ("PINJAR", "gas_ocgt"), ("ALBANY", "wind"), ("ALB", "wind"), ("X_BESS", None)], "station string, fuel string")
    wanted = {
        "COLLIE_G1": "COLLIE", "COLLIE_ESR1": None, "KWINANA_ESR1": "KWINANA_ESR", "KWINANA_GT2": "KWINANA", "MUJA_G7": "MUJA", "MUJA8": "MUJA", "PINJAR_GT10": "PINJAR",
        "ALBANY_WF1": "ALBANY", "ALBANYX": None, "ALB": "ALB", "": None, None: None, "X_BESS2": None, "COLLIER": None, "MUJA": "MUJA",
    }
    codes = spark.createDataFrame([(c,) for c in wanted] + [("MUJA",)], "code string")
    got = money.station_of_code(codes, stations).collect()
    assert len(got) == len(wanted) + 1 and {r.code: r.station for r in got} == wanted


def test_skill_is_told_from_fifty_on(spark):
    rows = spark.createDataFrame([(49, 0.5), (50, 0.5), (51, None)], "n int, skill double")
    assert [r.told for r in rows.orderBy("n").select(money.told_skill(F.col("n"), F.col("skill")).alias("told")).collect()] == [None, 0.5, None]


def test_a_fleet_claims_no_more_than_its_worst_member(spark):
    from tidewatt.operators import signals

    kind = "station string, region string, horizon string, capacity double, mw double, reference double, lo double, hi double, coverage double, skill double, masked double, curve_rmse double, n long, generated_at long, constrained boolean, weights map<string,double>"
    claims = spark.createDataFrame(
        [("a", "N", "1h", 300.0, 10.0, 5.0, 1.0, 20.0, 0.9, 0.2, 0.0, 0.1, 100, 7, False, {"x": 1.0}), ("b", "N", "1h", 100.0, 20.0, 5.0, 2.0, 30.0, 0.8, 0.6, 0.4, None, 50, 9, True, {"y": 1.0})], kind
    )
    prices = spark.createDataFrame([("N", 40.0)], "region string, rrp double")
    (r,) = signals.fleet_claims(claims, prices).collect()
    assert (r.stations, r.capacity, r.mw, r.lo, r.hi, r.coverage, r.n, r.generated_at) == (2, 400.0, 30.0, 3.0, 50.0, 0.8, 50, 7)
    assert (r.skill, r.masked, r.curve_rmse, r.constrained, r.price) == (pytest.approx(0.3), pytest.approx(0.1), pytest.approx(0.1), False, 40.0) and r.weights == pytest.approx({"x": 0.75, "y": 0.25})
    for bad in (prices.limit(0), prices.union(prices), prices.withColumn("rrp", F.lit(float("nan")))):
        with pytest.raises(Exception, match="no single price"):
            signals.fleet_claims(claims, bad).collect()


def test_small_rules(spark):
    from tidewatt.functions import physics, scores
    from tidewatt.sources import feeds

    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    nan = float("nan")
    assert [one(physics.clipped(F.lit(x).cast("double"), F.lit(c).cast("double"))) for x, c in ((5.0, 3.0), (-1.0, 3.0), (nan, 3.0), (9.0, None), (9.0, nan), (None, 3.0))] == [3.0, 0.0, 0.0, 9.0, 9.0, None]
    assert [one(physics.symlog_inverse(physics.symlog(F.lit(x)))) for x in (-1500.0, -10.0, 0.0, 3.0, 17500.0)] == pytest.approx([-1500.0, -10.0, 0.0, 3.0, 17500.0])
    assert one(scores.price_assumption(F.lit(42.5)))["basis"] == "flat $42.5/MWh across every forecast interval" and one(scores.price_assumption(F.lit(42.0)))["minutes"] == 5.0
    with pytest.raises(Exception, match="not a number"):
        one(scores.price_assumption(F.lit(nan)))
    names = spark.createDataFrame([("X_20240102_1.zip",), ("X_20240102_2.zip",), ("X_202401030405_9.zip",), ("none.zip",), ("X_20240102_10.zip",)], "name string")
    assert {r.day: r.name for r in feeds.newest_a_day(names).collect()} == {"20240102": "X_20240102_2.zip", "20240103": "X_202401030405_9.zip"}
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "k string, v double")
    assert {r.k: (r.n, r.m) for r in feeds.summary(rows, "k", "v", {"m": 0.5}).collect()} == {"a": (2, 1.5), "b": (0, None)}
