"""Forecasts met by their outcomes as both arrive, instants of a fleet told when complete, feeds without repeats in order.

Each is an append-mode query whose state is bounded by event time: what is due before the watermark leaves it.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers and map states need; to be set before a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def scored(forecasts: DataFrame, outcomes: DataFrame, late: str) -> DataFrame:
    """Streams of forecasts (key, due, ...) and outcomes (key, at, actual, usable), times as timestamps, to forecasts with the outcome of the
    instant they were due, actual null for those whose instant passed without a usable one.

    A match comes out in the micro-batch that has both; a forecast without one when the watermark of both streams, the
    greatest times less `late`, has passed its due time. So a forecast stays in state for its horizon and `late`, and
    an outcome for `late`. Outcomes are one a key and instant; a forecast or outcome that comes later than that is dropped.
    """
    f = forecasts.withWatermark("due", late)
    o = outcomes.where("usable and actual is not null").select(F.col("key").alias("o_key"), F.col("at").alias("o_at"), "actual").withWatermark("o_at", late)
    return f.join(o, (F.col("key") == F.col("o_key")) & (F.col("due") == F.col("o_at")), "left_outer").drop("o_key", "o_at")


def _millis(at: datetime.datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or datetime.UTC).timestamp() * 1000)


class FleetStage(StatefulProcessor):
    """Of one instant: the stations that are in, and a timer for when no more can come. It emits once, when all are in or the timer fires."""

    def __init__(self, stations: int):
        self.stations = stations

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("stations", "station long", "mw double, usable boolean")
        self.told = handle.getValueState("told", "told boolean")

    def _row(self, key: tuple) -> Row:
        rows = [v for _, v in self.held.iterator()]
        usable = sum(bool(v[1]) for v in rows)
        return Row(at=key[0], mw=float(sum(v[0] or 0.0 for v in rows)), n=len(rows), complete=len(rows) >= self.stations, scored=usable == self.stations)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.told.exists():
            return
        for r in rows:
            if not self.held.containsKey((r.station,)):
                self.held.updateValue((r.station,), (r.mw, r.usable))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(_millis(key[0]))
        row = self._row(key)
        if row.complete:
            self.held.clear()
            self.told.update((True,))
            yield row

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.told.exists():
            yield self._row(key)
        self.held.clear()
        self.told.clear()


FLEET = "at timestamp, mw double, n int, complete boolean, scored boolean"


def fleet_instants(readings: DataFrame, stations: int, late: str) -> DataFrame:
    """A stream of readings (station, at as a timestamp, mw, usable) to one row an instant: mw, n, complete, scored.

    Two stateful stages in one query: repeats of a station and instant are dropped first, then the stations of an instant are
    gathered. A complete instant comes out with its last station; others when the watermark passes them, as incomplete. `scored`
    says that all stations are in and usable. State holds the instants of the last `late` of event time.
    """
    first = readings.withWatermark("at", late).dropDuplicatesWithinWatermark(["station", "at"])
    return first.groupBy("at").transformWithState(FleetStage(stations), FLEET, "append", "EventTime")


class SeenFeed(StatefulProcessor):
    """Of one feed: intervals seen, and those that wait for their turn. Timers emit what waits, oldest first, once nothing older can come;
    what a manifest doesn't list any more, or is older than the feed keeps, is forgotten."""

    def __init__(self, since: int, kept_s: int):
        self.since, self.kept_s = since, kept_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "at long", "value double, emitted boolean")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        listed = None
        for r in rows:
            if r.listed is not None:  # the newest manifest of the batch counts
                listed = max(listed, (r.ts, r.listed)) if listed else (r.ts, r.listed)
            elif r.value is not None and int(r.at) > self.since and not self.seen.containsKey((r.at,)):  # a file that is gone has no value
                self.seen.updateValue((r.at,), (r.value, False))
                self.handle.registerTimer(_millis(r.ts))
        if listed:
            for (at,), (_, emitted) in list(self.seen.iterator()):
                if emitted and at not in listed[1]:
                    self.seen.removeKey((at,))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        n = self.count.get()[0] if self.count.exists() else 0
        for (a,), (value, emitted) in sorted(self.seen.iterator(), key=lambda kv: kv[0][0]):
            if a <= at and not emitted:
                n += 1
                yield Row(feed=key[0], at=a, value=value, place=n)
                self.seen.updateValue((a,), (value, True))
            elif emitted and a < at - self.kept_s:
                self.seen.removeKey((a,))
        self.count.update((n,))


FEED = "feed string, at long, value double, place long"


def unseen(feeds: DataFrame, late: str, since: int = 0, kept_s: int = 36 * 3600) -> DataFrame:
    """A stream of rows (feed, ts, at in seconds, value, listed) to the intervals of each feed, each once and oldest first: feed, at, value, and
    place, its number in the feed.

    Rows are intervals, or manifests with the intervals that the feed still lists (`listed`). Intervals at or before `since` and those
    without a value (swept meanwhile) are passed over and not marked as seen. An interval comes out when the watermark passes it. It is
    forgotten once a manifest doesn't list it, or after `kept_s` of event time, so what is known of a feed is bounded.
    """
    return feeds.withWatermark("ts", late).groupBy("feed").transformWithState(SeenFeed(since, kept_s), FEED, "append", "EventTime")
