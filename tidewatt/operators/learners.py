"""Path-dependent learners, a key at a time in its own order: experts, Hedge weights, adaptive conformal bands."""

from __future__ import annotations

import bisect
import math
import sys
from collections import deque
from collections.abc import Iterator, Sequence
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameters of the learners.
FLOOR, RATE_ROUNDS, GAMMA, WINDOW = 1e-4, 5000, 0.005, 2000
FORGET, START, TRACE_CAP = 0.999, 10.0, 1e6
NEAREST, LIBRARY = 25, 5000
HORIZONS = (1, 6, 12, 72, 288)
LEVELS = (0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95)
EXPERTS = ("persistence", "climatology", "curve", "ridge", "analogue", "ramp")
#: Coverages of the bands that end at the levels, each once; of each level the side of the point it lies on and its band's place.
COVERAGES = tuple(sorted({abs(2 * q - 1) for q in LEVELS if q != 0.5}))
SIDES = tuple((1 if q > 0.5 else -1, COVERAGES.index(abs(2 * q - 1))) if q != 0.5 else (0, 0) for q in LEVELS)
MIDDLE, ALL_COVERAGES = LEVELS.index(0.5), (*COVERAGES, 0.9)  # the last is the wide band's own
#: What a reading may carry besides its value: the share of capacity its weather gives, and weather scaled to about one.
CURVE, WEATHER = "share", ("wind", "clear", "warm")
SCHEMA = "key long, horizon int, step long, forecast double, actual double, lo double, hi double, lo80 double, hi80 double, quantiles array<double>, best string, weight double"


class Hedge:
    """Exponential weights with a floor, kept summing to one."""

    def __init__(self, n: int):
        self.held = [1 / n] * n  # a few numbers: plain floats take a tenth of the time of small arrays
        self.eta = math.sqrt(8 * math.log(n) / RATE_ROUNDS) / 0.2

    @property
    def w(self) -> np.ndarray:
        return np.array(self.held)

    def update(self, predictions: Sequence[float], actual: float, capacity: float) -> None:
        if not (math.isfinite(actual) and capacity > 0):
            return
        loss = [min(1.0, abs(p - actual) / capacity) if math.isfinite(p) else 1.0 for p in predictions]
        least = min(loss)
        w = [v * math.exp(-self.eta * (x - least)) for v, x in zip(self.held, loss, strict=True)]
        total = sum(w)
        w = [v / total for v in w]
        if min(w) < FLOOR:
            low = [v < FLOOR for v in w]
            while True:  # those at the floor are topped up by the rest
                scale = (1 - FLOOR * sum(low)) / sum(v for v, under in zip(w, low, strict=True) if not under)
                w = [FLOOR if under else v * scale for v, under in zip(w, low, strict=True)]
                if min(w) >= FLOOR:
                    break
                low = [under or v < FLOOR for v, under in zip(w, low, strict=True)]
        self.held = w


class Conformal:
    """Half widths from past errors, with a level that is moved until the wanted coverage is met."""

    def __init__(self, coverage: float):
        self.target = self.level = coverage
        self.errors: deque[float] = deque()
        self.ranked: list[float] = []

    def halves(self, capacity: float, coverages: Sequence[float]) -> list[float]:
        """Half widths for coverages: the level moves with the target's, 0 and 1 stay."""
        ranked, level, target = self.ranked, self.level, self.target
        n = len(ranked)
        if not n:
            return [capacity] * len(coverages)
        levels = [level * c / target if c < target else level if c == target else level + (1 - level) * (c - target) / (1 - target) for c in coverages]
        # places are not below 0, as these levels are above
        return [0.0 if v <= 0 else ranked[min(math.ceil((n + 1) * v) - 1, n - 1)] for v in levels]

    def half(self, capacity: float, coverage: float | None = None) -> float:
        """Half width for the target, or for another coverage."""
        return self.halves(capacity, (self.target if coverage is None else coverage,))[0]

    def update(self, error: float, hit: bool) -> None:
        self.level += GAMMA * (self.target - hit)
        self.errors.append(error)
        bisect.insort(self.ranked, error)
        if len(self.errors) > WINDOW:
            del self.ranked[bisect.bisect_left(self.ranked, self.errors.popleft())]


class Ridge:
    """Recursive least squares with forgetting on a constant and three lags."""

    def __init__(self, n: int = 4):
        self.w, self.p = [0.0] * n, [[START if i == j else 0.0 for j in range(n)] for i in range(n)]

    def predict(self, x: Sequence[float]) -> float:
        return sum(map(mul, self.w, x))

    def update(self, x: Sequence[float], y: float) -> None:
        p = self.p
        px = [sum(map(mul, row, x)) for row in p]
        by, missed = FORGET + sum(map(mul, x, px)), y - self.predict(x)
        gain = [v / by for v in px]
        self.w = [w + g * missed for w, g in zip(self.w, gain, strict=True)]
        for i, row in enumerate(p):
            for j in range(i + 1):  # both halves at once, so that rounding keeps them equal
                row[j] = p[j][i] = ((row[j] - gain[i] * px[j]) / FORGET + (p[j][i] - gain[j] * px[i]) / FORGET) / 2
        trace = sum(row[i] for i, row in enumerate(p))
        if trace > TRACE_CAP:
            self.p = [[v * (TRACE_CAP / trace) for v in row] for row in p]


def slope(last: list[float]) -> float:
    """Least-squares slope of the last six readings; 0 for fewer than two."""
    y = last[-6:]
    if len(y) < 2 or not all(map(math.isfinite, y)):
        return 0.0
    middle = (len(y) - 1) / 2
    return float(sum((i - middle) * v for i, v in enumerate(y)) / sum((i - middle) ** 2 for i in range(len(y))))


class Analogues:
    """The mean reading under the most alike conditions, by nearness; a ring of the newest. Equally near: the lower place."""

    def __init__(self, width: int):
        self.x, self.y, self.n = np.empty((width, 64)), np.empty(64), 0

    def predict(self, x: Sequence[float]) -> float:
        return self.predict_all([x])[0]

    def predict_all(self, asked: list[Sequence[float]]) -> list[float]:
        """The mean under each of some conditions."""
        held = min(self.n, LIBRARY)
        if held < NEAREST:
            return [math.nan] * len(asked)
        if held > 16 * NEAREST:
            return [self._mean(d, self._nearest(d)) for d in (self._distances(np.asarray(x, float)[:, None], held, 0) for x in asked)]
        d = self._distances(np.asarray(asked, float)[:, :, None], held, 1)
        pick = d.argsort(1, kind="stable")[:, :NEAREST]
        weights = 1 / (np.sqrt(d[np.arange(len(asked))[:, None], pick]) + 1e-3)
        return (np.add.reduce(self.y[pick] * weights, 1) / np.add.reduce(weights, 1)).tolist()

    def _distances(self, x: np.ndarray, held: int, axis: int) -> np.ndarray:
        off = self.x[:, :held] - x
        return np.add.reduce(np.multiply(off, off, out=off), axis)

    def _nearest(self, d: np.ndarray) -> np.ndarray:
        """Only those that can be among the nearest are sorted, in order of their place."""
        near = np.flatnonzero(~(d > np.partition(d, NEAREST - 1)[NEAREST - 1]))
        return near[d[near].argsort(kind="stable")[:NEAREST]]

    def _mean(self, d: np.ndarray, pick: np.ndarray) -> float:
        weights = 1 / (np.sqrt(d[pick]) + 1e-3)
        return float(np.add.reduce(self.y[pick] * weights) / np.add.reduce(weights))

    def update(self, x: Sequence[float], y: float) -> None:
        if self.n == len(self.y) < LIBRARY:
            more = min(LIBRARY, max(64, 2 * self.n)) - self.n
            self.x, self.y = np.hstack([self.x, np.empty((len(self.x), more))]), np.concatenate([self.y, np.empty(more)])
        at = self.n % LIBRARY
        self.x[:, at], self.y[at] = x, y
        self.n += 1

    def __getstate__(self) -> dict:
        """Without the places that aren't taken yet: streams keep a learner a key."""
        return {"x": self.x[:, : self.n].copy(), "y": self.y[: self.n].copy(), "n": self.n}


def _known(x: float) -> float:
    """As `numpy.nan_to_num`: unknown is 0, infinite is as large as can be."""
    return x if math.isfinite(x) else 0.0 if math.isnan(x) else math.copysign(sys.float_info.max, x)


class Learner:
    """All that one key has learned. A reading is taken in a fixed order: forecasts that are due are scored, the weights and
    bands of their horizon move, the experts learn, the next forecasts are made. One bank of experts serves all horizons; it
    learns one step ahead, before the new reading is in its history. Horizons count readings."""

    def __init__(self, capacity: float, horizons: tuple[int, ...] = (1,), warm_up: int = 1):
        self.capacity, self.horizons, self.warm_up = capacity, horizons, warm_up
        self.ridge, self.near, self.cells = Ridge(), Analogues(len(WEATHER) + 3), {}
        self.hedges = {h: Hedge(len(EXPERTS)) for h in horizons}
        self.bands = {h: (Conformal(0.9), Conformal(0.8)) for h in horizons}
        self.due: dict[int, list] = {}
        self.past: list[float] = []
        self.seen = 0

    def _lags(self) -> list[float]:
        past, most = self.past, len(self.past) - 1
        return [1.0, *(past[-1 - min(k, most)] / self.capacity for k in range(3))]

    def _conditions(self, at: Sequence[float]) -> list[float]:
        """Weather, the time of day in half hours on a circle, and the last reading; unknown weather is neutral."""
        turn = at[0] * math.pi / 24
        return [*map(_known, at[2:]), math.sin(turn), math.cos(turn), (self.past[-1] if self.past else 0.0) / self.capacity]

    def _forecasts(self, ahead: list[Sequence[float]]) -> Iterator[list[float]]:
        """What the experts say of each horizon under its conditions."""
        last, most, drift = self.past[-1], self.capacity, slope(self.past)
        lagged = self.ridge.predict(self._lags()) * most
        for h, at, alike in zip(self.horizons, ahead, self.near.predict_all([self._conditions(at) for at in ahead]), strict=True):
            made = (last, self.cells.get(at[0], (0, last))[1], at[1] * most, lagged, alike, last + drift * h * math.exp(-h / 12))
            yield [v if 0.0 <= v <= most else self._clipped(v, last) for v in made]

    def _clipped(self, v: float, last: float) -> float:
        v = v if math.isfinite(v) else last
        return 0.0 if v < 0 else self.capacity if v > self.capacity else v

    def _score(self, actual: float) -> Iterator[tuple]:
        for h, made, point, scale, quantiles, *ends in self.due.pop(self.seen, []):
            lo, hi, lo80, hi80 = ends
            hedge, (wide, narrow) = self.hedges[h], self.bands[h]
            yield h, point, actual, lo, hi, lo80, hi80, quantiles, EXPERTS[hedge.held.index(max(hedge.held))], max(hedge.held)
            hedge.update(made, actual, self.capacity)
            wide.update(abs(point - actual) / scale, lo <= actual <= hi)
            narrow.update(abs(point - actual) / scale, lo80 <= actual <= hi80)

    def _learn(self, actual: float, at: Sequence[float]) -> None:
        if self.past:
            self.ridge.update(self._lags(), actual / self.capacity)
        self.near.update(self._conditions(at), actual)
        n, mean = self.cells.get(at[0], (0, 0.0))
        self.cells[at[0]] = (min(500, n + 1), mean + (actual - mean) / min(500, n + 1))
        self.past.append(actual)
        del self.past[:-WINDOW]

    def _issue(self, horizon: int, made: list[float]) -> None:
        point, most = sum(map(mul, self.hedges[horizon].held, made)), self.capacity
        scale = max(point, 0.05 * most) / most
        wide, narrow = self.bands[horizon]
        by = scale if wide.errors else 1  # both bands have errors, or neither
        *halves, half = [v * by for v in wide.halves(most, ALL_COVERAGES)]
        half80 = narrow.half(most) * by
        ends = [point + side * halves[i] if side else point for side, i in SIDES]
        ends += (point - half, point + half, point - half80, point + half80)
        ends = [v if 0.0 < v < most else most if v >= most else 0.0 for v in ends]
        ends[MIDDLE] = point
        self.due.setdefault(self.seen + horizon - 1, []).append((horizon, made, point, scale, ends[:-4], *ends[-4:]))

    def read(self, actual: float, at: Sequence[float], ahead: list[Sequence[float]] | None = None) -> list[tuple]:
        """Takes a reading made under `at` (half hour of day, share, weather); `ahead` is what is known of each horizon's
        conditions, else those of now. Returns the forecasts that were due, scored."""
        scored = list(self._score(actual))
        self._learn(actual, at)
        self.seen += 1
        if self.seen >= self.warm_up:
            for h, made in zip(self.horizons, self._forecasts(ahead or [at] * len(self.horizons)), strict=True):
                self._issue(h, made)
        return scored


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[c.split()[1]] for c in SCHEMA.split(", ")]
#: Scored forecasts that are sent on at once.
BATCH = 8192


def conditions_of(frame: pd.DataFrame) -> np.ndarray:
    return np.column_stack([frame[c].to_numpy(float) if c in frame else np.full(len(frame), math.nan) for c in ("slot", CURVE, *WEATHER)])


def walked(key: int, steps: list, values: list[float], at: list[list[float]], capacity: float, horizons: tuple[int, ...], warm_up: int) -> Iterator[tuple]:
    """A key's readings in order, as rows of SCHEMA; conditions at a horizon are those of its reading, or of the last where there is none."""
    learner, last = Learner(capacity, horizons, warm_up), len(values) - 1
    for i, (step, value) in enumerate(zip(steps, values, strict=True)):
        for h, *rest in learner.read(value, at[i], [at[min(i + h, last)] for h in horizons]):
            yield key, h, step, *rest


def walk(frame: pd.DataFrame, horizons: tuple[int, ...] = (1,), warm_up: int = 1) -> pd.DataFrame:
    """`walked` of a key's readings in a frame."""
    rows = walked(frame["key"].iloc[0], frame["step"].tolist(), frame["value"].astype(float).tolist(), conditions_of(frame).tolist(), float(frame["capacity"].iloc[0]), horizons, warm_up)
    return pd.DataFrame(list(rows), columns=COLUMNS)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of rows in order of key: each key with the lists of its steps, values and conditions, and its first capacity."""
    key, held = None, None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in ("key", "step", "value", "capacity")}
        at = np.column_stack([batch.column(c).cast("double").to_numpy(zero_copy_only=False) if c in batch.schema.names else np.full(len(batch), math.nan) for c in ("slot", CURVE, *WEATHER)]).tolist()
        for k, step, value, capacity, conditions in zip(*columns.values(), at, strict=True):
            if held is None or k != key:
                if held:
                    yield key, *held
                key, held = k, ([], [], [], float(capacity))
            held[0].append(step)
            held[1].append(float(value))
            held[2].append(conditions)
    if held:
        yield key, *held


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def walk_forward(readings: DataFrame, horizons: tuple[int, ...] = (1,), warm_up: int = 1) -> DataFrame:
    """Readings (key, step, value, slot, capacity, and where known share, wind, clear, warm) to scored forecasts.

    Rows without a value are left out; keys of no more rows than a horizon give none for it. A capacity that is unknown or not
    above 0 is refused: what the series itself reaches is only known at its end. Unknown share: the last reading. Equal
    steps of a key keep no set order.
    """
    if "capacity" not in readings.columns:
        raise ValueError("readings need their capacity")
    known = F.when((F.col("capacity") > 0) & ~F.isnan("capacity"), F.col("capacity").cast("double")).otherwise(F.raise_error(F.lit("a capacity is unknown")).cast("double"))
    wanted = [c for c in ("key", "step", "value", "slot", "capacity", CURVE, *WEATHER) if c in readings.columns]
    # a set number of partitions: a reading is small but its learning is not, so they must not be coalesced by size
    parts = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = readings.where("value is not null").withColumn("capacity", known).select(wanted).repartition(parts, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = pa.schema([pa.field(n, t) for n, t in zip(COLUMNS, TYPES, strict=True)]), []
        for key in _by_key(batches):
            for row in walked(*key, horizons, warm_up):
                out.append(row)
                if len(out) == BATCH:
                    yield _sent(out, schema)
                    out = []
        if out:
            yield _sent(out, schema)

    # keys come whole and in order, so that a task reads Arrow batches of many keys instead of a table for each
    return rows.sortWithinPartitions("key", "step").mapInArrow(run, SCHEMA)
