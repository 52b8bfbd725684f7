"""The engine's queries against DuckDB, and hand-checked cases of its functions and learners."""

import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt import plans
from tidewatt.functions import physics, scores, text
from tidewatt.operators import learners
from tidewatt.operators.timeaxis import as_of, interpolated, lagged_correlation
from tidewatt.sources.report import parse, read_reports

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents labels".split():
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return f"{x + 0.0:.6g}" if isinstance(x, float) else str(pd.Timestamp(x)) if isinstance(x, (pd.Timestamp, np.datetime64, datetime.date)) else str(x)

    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_duckdb(spark, duck, name):
    assert rows(plans.queries()[name](spark, SF).toPandas()) == rows(duck.sql(plans.oracle_sql()[name]).df())


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hand_checked_scores(spark):
    assert value(spark, scores.pinball(F.lit(0.9), F.lit(100.0), F.lit(110.0))) == pytest.approx(9)
    assert value(spark, scores.pinball(F.lit(0.9), F.lit(100.0), F.lit(90.0))) == pytest.approx(1)
    knots = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(v).alias("v")) for q, v in ((0.1, 10.0), (0.5, 20.0), (0.9, 30.0))])
    assert [value(spark, scores.pit(knots, F.lit(x))) for x in (15.0, 5.0, 99.0)] == pytest.approx([0.3, 0.05, 0.95])
    assert value(spark, scores.revenue(F.lit(100.0), F.lit(100.0))) == pytest.approx(833.3333333)
    assert value(spark, scores.skill(F.lit(1.0), F.lit(0.0))) == 0


def test_hand_checked_physics(spark):
    assert value(spark, physics.air_density(F.lit(101325.0), F.lit(15.0))) == pytest.approx(1.225, abs=0.005)
    assert value(spark, physics.wind_power(F.lit(1.225), F.lit(10.0))) == pytest.approx(612.5)
    assert value(spark, physics.wind_fraction(F.lit(2.0))) == 0
    assert value(spark, physics.clear_sky_ghi(F.lit(-0.1))) == 0


def test_text(spark):
    tokens = F.split(F.lit("A_B_C"), "_")
    assert value(spark, text.contains_run(tokens, F.split(F.lit("B_C"), "_")))
    assert not value(spark, text.contains_run(tokens, F.split(F.lit("A_C"), "_")))
    assert value(spark, text.prefix_match(F.lit("STA_1"), F.lit("STA"))) and not value(spark, text.prefix_match(F.lit("STAX"), F.lit("STA")))
    assert str(value(spark, text.fixed_offset(F.lit("2024/01/01 00:05")))) == "2023-12-31 14:05:00"
    assert value(spark, text.fixed_offset(F.lit("nonsense"))) is None


def test_interpolation_gaps_ends_and_samples(spark):
    samples = spark.createDataFrame([(1, 0, 0.0), (1, 10, 10.0), (1, 100, 100.0)], "k int, t int, v double")
    grid = spark.createDataFrame([(1, -5), (1, 0), (1, 4), (1, 50), (1, 100), (1, 120), (2, 3)], "k int, t int")
    got = {(r.k, r.t): r.v for r in interpolated(grid, samples, "k", "t", "v", max_gap=20).collect()}
    assert got == {(1, -5): None, (1, 0): 0.0, (1, 4): 4.0, (1, 50): None, (1, 100): 100.0, (1, 120): None, (2, 3): None}
    assert {r.t: r.v for r in interpolated(grid, samples, "k", "t", "v", hold=True).where("k = 1").collect()}[120] == 100.0
    assert {(r.k, r.t): r.v for r in as_of(grid, samples, "k", "t", "v").collect()}[1, 50] == 10.0


def test_lag_is_found_and_constants_correlate_with_nothing(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    frame = pd.DataFrame({"k": 1, "i": range(400), "x": x, "y": np.roll(x, 7)}).iloc[10:]
    got = {r.lag: r.r for r in lagged_correlation(spark.createDataFrame(frame), "k", "i", "x", "y", 10).collect()}
    assert max(got, key=lambda lag: abs(got[lag])) == 7
    flat = lagged_correlation(spark.createDataFrame(frame.assign(y=1.0)), "k", "i", "x", "y", 2)
    assert {r.r for r in flat.collect()} == {0.0}


def test_hedge_finds_the_best_and_keeps_the_floor():
    h = learners.Hedge(3)
    for _ in range(2000):
        h.update(np.array([10.0, 50.0, 90.0]), 50.0, 100.0)
    assert h.w.argmax() == 1 and h.w.sum() == pytest.approx(1) and h.w.min() >= learners.FLOOR - 1e-12


def test_conformal_covers():
    rng, band, hits = np.random.default_rng(2), learners.Conformal(0.9), []
    for _ in range(4000):
        error = abs(rng.normal())
        hits.append(error <= band.half(100.0))
        band.update(error, hits[-1])
    assert np.mean(hits[500:]) == pytest.approx(0.9, abs=0.02)


def test_ridge_recovers_a_line():
    rng, r = np.random.default_rng(3), learners.Ridge(2)
    for _ in range(500):
        x = np.array([1.0, rng.normal()])
        r.update(x, 2 + 3 * x[1])
    assert r.w == pytest.approx([2, 3], abs=1e-3)


REPORT = 'C,SETP,x\nI,DISPATCH,UNIT,1,ID,MW,NOTE\nD,DISPATCH,UNIT,1,"A ""x""",5.5,\nD,DISPATCH,UNIT,1,B\nI,PRICE,REGION,1,R\nD,PRICE,REGION,1,NSW\nC,"END OF REPORT",7\n'


def test_reports(spark, tmp_path):
    (tmp_path / "r.csv").write_text(REPORT)
    got = read_reports(spark, str(tmp_path), ["DISPATCH.UNIT"]).orderBy("line_no").collect()
    assert [r.cells for r in got] == [{"ID": 'A "x"', "MW": "5.5", "NOTE": None}, {"ID": "B", "MW": None, "NOTE": None}]
    for broken in (REPORT.replace(",7\n", ",8\n"), REPORT.replace("I,PRICE", "X,PRICE"), "D,A,B,1,2\n", REPORT.replace("NSW", "NSW,1")):
        with pytest.raises(ValueError):
            list(parse(broken))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "key long, step long, value double, slot long, capacity double")
    assert learners.walk_forward(empty).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        learners.walk_forward(empty.drop("capacity"))
    for bad in (None, 0.0, math.nan):
        with pytest.raises(Exception, match="a capacity is unknown"):
            learners.walk_forward(spark.createDataFrame([(1, 1, 2.0, 0, bad)], empty.schema)).collect()
    assert lagged_correlation(empty, "key", "step", "value", "slot", 3).count() == 0


def _huber(p, x, y, delta=0.08):
    r = np.abs(p[0] + (p[1] - p[0]) / (1 + np.exp(-np.clip(p[2] * (x - p[3]), -50, 50))) - y)
    return float(np.where(r <= delta, r * r / 2, delta * (r - delta / 2)).sum())


def _searched(x, y, start):
    """The least Huber loss near a start, by trying steps of every parameter and halving them."""
    lower, upper, best = np.array([0.0, 0.0, 0.05, 2.0]), np.array([1.2, 1.2, 10.0, 20.0]), np.array(start, float)
    step, loss = np.array([0.02, 0.02, 0.1, 0.5]), _huber(start, x, y)
    rng = np.random.default_rng(0)
    while step.max() > 1e-9:
        tries = best + step * rng.normal(size=(60, 4))
        tries = np.clip(tries, lower, upper)
        losses = [_huber(t, x, y) for t in tries]
        if min(losses) < loss:
            best, loss = tries[int(np.argmin(losses))], min(losses)
        else:
            step = step / 1.5
    return best, loss


def test_wind_fit_finds_the_least_loss(spark):
    """Exact curves, noise with outliers, a key of too few rows, nulls, a flat key."""
    from tidewatt.operators.fits import fit_wind, with_curves

    rng = np.random.default_rng(5)
    x = rng.uniform(1, 24, 400)

    def curve(p, v):
        return p[0] + (p[1] - p[0]) / (1 + np.exp(-p[2] * (v - p[3])))

    data = {1: curve([0.0, 0.95, 0.6, 10.0], x), 3: curve([0.05, 0.7, 1.1, 7.0], x) + rng.normal(0, 0.04, 400), 4: np.full(400, 0.3)}
    data[3][:40] = rng.uniform(0, 1, 40)
    frame = pd.concat([*(pd.DataFrame({"key": k, "speed": x, "share": y}) for k, y in data.items()), pd.DataFrame({"key": 2, "speed": x[:50], "share": 0.5}), pd.DataFrame({"key": 3, "speed": [5.0, np.nan], "share": [np.nan, 1.0]})])
    rows = spark.createDataFrame(frame).repartition(5)
    got = {r.key: r for r in fit_wind(rows).collect()}
    assert set(got) == {1, 3, 4} and all(r.n == 400 for r in got.values())
    assert [got[1][c] for c in ("low", "high", "slope", "middle")] == pytest.approx([0.0, 0.95, 0.6, 10.0], abs=1e-6) and got[1].converged
    for k in (3, 4):
        p = [got[k][c] for c in ("low", "high", "slope", "middle")]
        assert _huber(p, x, data[k]) <= _searched(x, data[k], p)[1] + 1e-6
    best, loss = _searched(x, data[3], [0.0, 0.95, 0.6, 9.0])
    assert [got[3][c] for c in ("low", "high", "slope", "middle")] == pytest.approx(best, abs=1e-3) and _huber([got[3][c] for c in ("low", "high", "slope", "middle")], x, data[3]) <= loss + 1e-6
    told = {r.key: r.curve for r in with_curves(spark.range(1, 4).withColumnRenamed("id", "key"), fit_wind(rows), [3.0, 10.0]).collect()}
    assert told[2] is None and told[1] == pytest.approx([curve([0.0, 0.95, 0.6, 10.0], v) for v in (3.0, 10.0)], abs=1e-6)
    assert fit_wind(rows.limit(0)).count() == 0
