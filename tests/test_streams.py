"""Streams with state bounded by event time, and ordered recurrences split over tasks, on small hand-made inputs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewatt.operators import climatology
from tidewatt.operators.prefix import affine_prefix, rank_in_group
from tidewatt.plans import streams
from tidewatt.streaming import outcomes


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


@pytest.fixture
def timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    outcomes.with_timers(spark)
    yield spark
    spark.conf.set(key, before)


def arriving(spark, folder, batches, schema):
    """A stream of some batches, in their order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, folder):
    """What each run of a stream adds, by micro-batch."""
    out = []
    query = stream.writeStream.foreachBatch(lambda df, n: out.append(sorted(map(tuple, df.collect()), key=repr))).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    return [b for b in out if b]


FORECASTS = "key string, due timestamp, value double"
OUTCOMES = "key string, at timestamp, actual double, usable boolean"


def test_forecasts_meet_their_outcomes(spark, tmp_path):
    """A match comes with the later side; a forecast whose instant had no usable outcome comes once that has passed."""
    f = arriving(spark, tmp_path / "f", [[("a", at(100), 1.0), ("a", at(200), 2.0), ("b", at(100), 3.0)], [("a", at(900), 4.0)], [("a", at(5000), 5.0)]], FORECASTS)
    o = arriving(spark, tmp_path / "o", [[("a", at(100), 10.0, True)], [("a", at(200), 20.0, False), ("a", at(900), None, True)], [("a", at(5000), 50.0, True), ("c", at(5000), 1.0, True)]], OUTCOMES)
    got = run(outcomes.scored(f, o, "60 seconds").select("key", F.unix_timestamp("due") - 1_704_067_200, "value", "actual"), tmp_path / "state")
    rows = [r for b in got for r in b]
    assert sorted(rows, key=repr) == sorted([("a", 100, 1.0, 10.0), ("a", 5000, 5.0, 50.0), ("a", 200, 2.0, None), ("b", 100, 3.0, None), ("a", 900, 4.0, None)], key=repr)
    assert rows[0] == ("a", 100, 1.0, 10.0)  # before those that had to be waited for


READINGS = "station long, at timestamp, mw double, usable boolean"


def test_fleet_instants_are_told_once(timers, tmp_path):
    spark = timers
    batches = [
        [(1, at(0), 1.0, True), (2, at(0), 2.0, True), (1, at(0), 9.0, True)],  # a repeat; two of three stations
        [(3, at(0), 4.0, False), (1, at(300), 1.0, True)],  # the first instant is complete, a station unusable
        [(2, at(300), 1.0, True), (1, at(600), 5.0, True), (2, at(600), 5.0, True), (3, at(600), 5.0, True)],
        [(1, at(9000), 1.0, True)],  # long after: the second instant can't be completed any more
        [(3, at(300), 7.0, True)],  # too late
    ]
    stream = outcomes.fleet_instants(arriving(spark, tmp_path / "r", batches, READINGS), 3, "60 seconds")
    got = run(stream.select(F.unix_timestamp("at") - 1_704_067_200, "mw", "n", "complete", "scored"), tmp_path / "state")
    assert [r for b in got for r in b] == [(0, 7.0, 3, True, False), (600, 15.0, 3, True, True), (300, 2.0, 2, False, False)]


FEEDS = "feed string, ts timestamp, at long, value double, listed array<long>"
START = 1_704_067_200


def interval(t, value=1.0):
    return ("nem", at(t), START + t, value, None)


def listing(t, *ats):
    return ("nem", at(t), None, None, [START + a for a in ats])


def seen(spark, tmp_path, batches, **more):
    stream = outcomes.unseen(arriving(spark, tmp_path / "in", batches, FEEDS), "60 seconds", **more)
    return [(a - START, v, p) for b in run(stream.select("at", "value", "place"), tmp_path / "state") for a, v, p in sorted(b, key=lambda r: r[2])]


def test_only_intervals_after_what_is_loaded_come(timers, tmp_path):
    assert seen(timers, tmp_path, [[interval(100), interval(200, 5.0), interval(300, 6.0)], [interval(2000)]], since=START + 100) == [(200, 5.0, 1), (300, 6.0, 2)]


def test_an_interval_comes_once(timers, tmp_path):
    assert seen(timers, tmp_path, [[interval(200)], [interval(200)], [interval(2000)], [interval(5000)]]) == [(200, 1.0, 1), (2000, 1.0, 2)]


def test_intervals_come_oldest_first(timers, tmp_path):
    assert seen(timers, tmp_path, [[interval(300, 3.0), interval(100, 1.0)], [interval(290, 2.0), interval(2000)]]) == [(100, 1.0, 1), (290, 2.0, 2), (300, 3.0, 3)]


def test_a_swept_file_is_passed_over_and_not_marked(timers, tmp_path):
    got = seen(timers, tmp_path, [[interval(100, None), interval(200, 9.0)], [interval(250), interval(180, 4.0)], [interval(2000)]])
    assert got == [(180, 4.0, 1), (200, 9.0, 2), (250, 1.0, 3)]


def test_what_is_not_listed_any_more_is_forgotten(timers, tmp_path):
    processor = outcomes.SeenFeed(0, 500)
    stored, timers_set = {}, []

    class Held:
        def containsKey(self, k):
            return k in stored

        def updateValue(self, k, v):
            stored[k] = v

        def removeKey(self, k):
            del stored[k]

        def iterator(self):
            return iter(list(stored.items()))

    class Count:
        n = None

        def exists(self):
            return self.n is not None

        def get(self):
            return self.n

        def update(self, v):
            self.n = v

    class Handle:
        def getMapState(self, *a):
            return Held()

        def getValueState(self, *a):
            return Count()

        def registerTimer(self, ms):
            timers_set.append(ms)

    class Info:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

    from pyspark.sql import Row

    def rows(*each):
        return [Row(feed=f, ts=ts, at=a, value=v, listed=m) for f, ts, a, v, m in each]

    processor.init(Handle())
    list(processor.handleInputRows(("nem",), rows(interval(100), interval(200)), None))
    assert timers_set == [(START + 100) * 1000, (START + 200) * 1000]
    assert [r["at"] - START for ms in timers_set for r in processor.handleExpiredTimer(("nem",), None, Info(ms))] == [100, 200]
    list(processor.handleInputRows(("nem",), rows(listing(210, 200), interval(300)), None))
    assert sorted(k[0] - START for k in stored) == [200, 300]  # 100 went; 300 still waits, though it isn't listed
    assert [r.place for r in processor.handleExpiredTimer(("nem",), None, Info((START + 300) * 1000))] == [3]
    list(processor.handleExpiredTimer(("nem",), None, Info((START + 900) * 1000)))
    assert not stored  # kept for 500 seconds


def test_affine_prefixes_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), i, rng.uniform(-1, 1), rng.uniform(-5, 5)) for i in range(2500)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r.i: r.x for r in affine_prefix(spark.createDataFrame(rows, "g string, i long, a double, b double").repartition(5), F.col("g"), [F.col("i").asc()], F.col("a"), F.col("b"), "x").collect()}
        ranks = {r.i: r["rank"] for r in rank_in_group(spark.createDataFrame(rows, "g string, i long, a double, b double"), F.col("g"), [F.col("a").desc()]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    state = {}
    for g, i, a, b in rows:
        state[g] = a * state.get(g, 0.0) + b
        assert got[i] == pytest.approx(state[g], rel=1e-9, abs=1e-9)
    for g in ("hot", "b", None):
        assert [ranks[r[1]] for r in sorted((r for r in rows if r[0] == g), key=lambda r: -r[2])] == list(range(1, sum(r[0] == g for r in rows) + 1))
    assert affine_prefix(spark.createDataFrame([], "g string, a double"), F.col("g"), [F.col("a")], F.col("a"), F.col("a"), "x").count() == 0


def test_climatology_equals_a_plain_loop(spark):
    """Cells with more than 500 readings, a hot station, months with cells of their own and without."""
    rng = random.Random(6)
    rows = [("s" if rng.random() < 0.9 else "t", 1_700_000_000 + rng.randrange(60 * 86_400), rng.choice([rng.uniform(0, 99), None, float("nan")] if i % 50 == 0 else [rng.uniform(0, 99)])) for i in range(3000)]
    known = climatology.cells(spark.createDataFrame(rows, "station string, at long, value double").repartition(4), 720)
    got = {(r.station, r.month, r.bucket): (r["mean"], r.n) for r in known.collect()}
    want: dict = {}
    for s, t, v in sorted((r for r in rows if r[2] is not None and r[2] == r[2]), key=lambda r: (r[1], r[2])):
        d = datetime.datetime.fromtimestamp(t, datetime.UTC)
        for month in (d.month, None):
            mean, n = want.get((s, month, d.hour // 12), (0.0, 0))
            n += 1
            want[s, month, d.hour // 12] = (mean + max(1 / n, 1 / 500) * (v - mean), n)
    assert max(n for _, n in want.values()) > 1000 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    targets = spark.createDataFrame([("s", 1_700_000_000, 5.0, 1000.0), ("s", 1_690_000_000, 5.0, 1000.0), ("new", 1_700_000_000, 5.0, 3.0), ("s", 1_700_000_000, 5.0, 1.0)], "station string, at long, last double, capacity double")
    told = [r.expected for r in climatology.expected(targets, known, 720).orderBy("station", "capacity", "at").collect()]
    assert told[0] == 3.0 and told[1] == 1.0 and told[3] == pytest.approx(want["s", 11, 1][0]) and told[2] == pytest.approx(want["s", None, 0 if datetime.datetime.fromtimestamp(1_690_000_000, datetime.UTC).hour < 12 else 1][0])


def test_a_micro_batch_of_many_files_comes_whole_and_in_order(spark):
    """Slices of 1,000, 300 and 1 rows, of four files each: three micro-batches, each row once."""
    rows = spark.range(1300).select((F.when(F.col("id") < 1000, F.col("id")).otherwise(F.col("id") + 200)).alias("at"), "id").unionByName(spark.createDataFrame([(2999, 2999)], "at long, id long"))
    stream, seen = streams._stream(rows, "at", "cut", 300), []
    query = stream.writeStream.trigger(availableNow=True).foreachBatch(lambda b, n: seen.append(sorted(r.id for r in b.collect()))).start()
    query.awaitTermination()
    assert seen == [list(range(1000)), list(range(1000, 1300)), [2999]]
