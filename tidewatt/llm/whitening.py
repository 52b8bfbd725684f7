"""Whitening of embeddings: streaming covariance, merged in a tree, and a symmetric QR eigen-solve.

Every task runs over its rows once and keeps a Welford state per partition: count, mean and
the matrix of centred products, updated by one rank-one term a row. States are merged by the
parallel update formula, FAN_IN of them in a task, until one is left, so neither a task nor
the driver ever holds more than FAN_IN matrices. The covariance of one state (dimensions
squared) is reduced to three diagonals and solved by implicit QR steps on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import released, written

#: States that one task merges.
FAN_IN = 16
#: Most components that are returned.
COMPONENTS = 32
#: Whole numbers of vectors lie within this bound, so that differences stay exact.
LIMIT = 1 << 61

_STATE = "slot long, n long, origin array<double>, whole array<long>, mean array<double>, products binary, sums array<decimal(38,0)>"


@dataclass
class State:
    """Count, an origin near the data, the mean from the origin, centred products; exact sums from the origin for whole numbers."""

    n: int
    origin: np.ndarray
    mean: np.ndarray
    products: np.ndarray
    sums: list[int] | None

    @classmethod
    def at(cls, origin: np.ndarray) -> State:
        d = len(origin)
        return cls(0, origin.copy(), np.zeros(d), np.zeros((d, d)), [0] * d if origin.dtype == np.int64 else None)

    def add(self, vectors: np.ndarray) -> None:
        """One rank-one update for each row."""
        moved = vectors - self.origin
        term = np.empty_like(self.products)
        for row in moved.astype(np.float64):
            self.n += 1
            step = row - self.mean
            self.mean += step / self.n
            np.multiply(step[:, None], step * ((self.n - 1) / self.n), out=term)
            self.products += term
        if self.sums is not None:
            high, low = (moved >> 31).sum(axis=0), (moved & 0x7FFFFFFF).sum(axis=0)
            self.sums = [s + (int(h) << 31) + int(v) for s, h, v in zip(self.sums, high, low, strict=True)]

    def merge(self, other: State) -> None:
        """The parallel update formula; both means are told from their own origins."""
        n, away = self.n + other.n, other.origin - self.origin
        step = away.astype(np.float64) + (other.mean - self.mean)
        self.products += other.products + np.outer(step, step * (self.n * (other.n / n)))
        self.mean += step * (other.n / n)
        if self.sums is not None:
            self.sums = [a + b + int(o) * other.n for a, b, o in zip(self.sums, other.sums, away, strict=True)]
        self.n = n


@dataclass
class Whitening:
    """A fit: n vectors; mean; for whole numbers the exact sums; eigenvalues by falling size, unit eigenvectors as rows."""

    n: int
    mean: np.ndarray
    sums: list[int] | None
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)

    def components(self, most: int = COMPONENTS) -> int:
        """How many leading components can be divided by their deviation: those of an eigenvalue above rounding."""
        least = len(self.values) * np.finfo(float).eps * max(float(self.values[0]), 0.0) if len(self.values) else 0.0
        return min(most, int((self.values > least).sum()))


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and basis (as rows) of a symmetric matrix, by reflections."""
    a, d = matrix.copy(), len(matrix)
    basis = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        length = math.sqrt(float(v @ v))
        if not length:
            continue
        v[0] += math.copysign(length, v[0])
        v /= math.sqrt(float(v @ v))
        part = a[k:, k:]
        full = np.concatenate([[0.0], v])
        p = 2.0 * (part @ full)
        w = p - (full @ p) * full
        part -= np.outer(full, w) + np.outer(w, full)
        basis[k + 1 :] -= np.outer(2.0 * v, v @ basis[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), basis


def symmetric_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as rows, by QR steps with Wilkinson's shift.

    The sign of a vector is that of its largest entry, so that reruns agree."""
    scale = float(np.abs(matrix).max(initial=0.0)) or 1.0
    a, b, basis = tridiagonal((matrix + matrix.T) / (2.0 * scale))
    eps, high = np.finfo(float).eps, len(a) - 1
    while high > 0:
        if abs(b[high - 1]) <= eps * (abs(a[high - 1]) + abs(a[high])):
            high -= 1
            continue
        low = high - 1
        while low > 0 and abs(b[low - 1]) > eps * (abs(a[low - 1]) + abs(a[low])):
            low -= 1
        half, off = (a[high - 1] - a[high]) / 2.0, b[high - 1]
        x, z = a[low] - a[high] + off * off / (half + math.copysign(math.hypot(half, off), half)), b[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                b[k - 1] = r
            p, q, o = a[k], a[k + 1], b[k]
            a[k], a[k + 1] = c * c * p + 2 * c * s * o + s * s * q, s * s * p - 2 * c * s * o + c * c * q
            b[k] = c * s * (q - p) + (c * c - s * s) * o
            if k < high - 1:
                x, z, b[k + 1] = b[k], s * b[k + 1], c * b[k + 1]
            basis[k], basis[k + 1] = c * basis[k] + s * basis[k + 1], c * basis[k + 1] - s * basis[k]
    order = np.argsort(-a, kind="stable")
    rows = basis[order]
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]) if len(rows) else np.ones(0)
    return a[order] * scale, rows * signs[:, None]


def _matrix(column: pa.ListArray, whole: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64 if whole else np.float64, copy=False).reshape(len(column), -1)


def _batch(slot: int, s: State) -> pa.RecordBatch:
    whole = s.sums is not None
    rows = {"slot": [slot], "n": [s.n], "origin": [None if whole else s.origin.tolist()], "whole": [s.origin.tolist() if whole else None]}
    rows |= {"mean": [s.mean.tolist()], "products": [s.products.tobytes()], "sums": [[Decimal(v) for v in s.sums] if whole else None]}
    types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))


def _states(table: pa.Table) -> Iterator[tuple[int, State]]:
    for r in table.to_pylist():
        d = len(r["mean"])
        origin = np.array(r["origin"], np.float64) if r["whole"] is None else np.array(r["whole"], np.int64)
        sums = None if r["sums"] is None else [int(v) for v in r["sums"]]
        yield r["slot"], State(r["n"], origin, np.array(r["mean"]), np.frombuffer(r["products"]).reshape(d, d).copy(), sums)


def usable(df: DataFrame, column: str = "vector") -> DataFrame:
    """Rows whose vector is neither null nor empty and has finite entries only (whole numbers: below LIMIT), of the
    commonest length (of equally common ones the greatest)."""
    v = df[column]
    whole = "bigint" in df.schema[column].dataType.simpleString()
    good = (lambda c: c.isNotNull() & (F.abs(c) < F.lit(LIMIT))) if whole else (lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, good))
    length = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size(v) == (length.d if length else 0))


def fit(df: DataFrame, column: str = "vector") -> Whitening | None:
    """The covariance (divisor: their number) and its eigenvectors over all vectors of a table of `usable` rows; None
    without rows. A column of array<bigint> gives exact sums, else it is read as array<double>."""
    whole = df.schema[column].dataType.simpleString() == "array<bigint>"

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(0), whole)
                state = state or State.at(vectors[0])
                state.add(vectors)
        if state:
            yield _batch(TaskContext.get().partitionId(), state)

    def merged(table: pa.Table) -> pa.Table:
        slot, total = 0, None
        for s, state in sorted(_states(table), key=lambda x: x[0]):
            if total is None:
                slot, total = s // FAN_IN, state
            else:
                total.merge(state)
        return pa.Table.from_batches([_batch(slot, total)])

    vectors = df.select(F.col(column).cast("array<bigint>" if whole else "array<double>").alias("v"))
    states = written(vectors.mapInArrow(scan, _STATE), "welford")
    last = states.agg(F.max("slot")).first()[0]
    while last:
        states = states.groupBy(F.floor(F.col("slot") / FAN_IN).alias("group")).applyInArrow(merged, _STATE)
        last //= FAN_IN
        states = written(states, "welford")
    found = states.toArrow()  # one state
    for _, s in _states(found):
        covariance = s.products / s.n
        values, rows = symmetric_eigen(covariance)
        sums = None if s.sums is None else [v + int(o) * s.n for v, o in zip(s.sums, s.origin, strict=True)]
        mean = s.origin + s.mean if sums is None else np.array([v / s.n for v in sums])
        return Whitening(s.n, mean, sums, covariance, values, rows)
    return None


def _centred(vectors: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int] | None]:
    """Vectors less the mean; for whole numbers by exact differences n*x - S, whose squares are summed too."""
    if model.sums is None:
        return vectors - model.mean, None
    n, widest = model.n, max(1, max(abs(s) for s in model.sums))
    if max(n * max(int(np.abs(vectors).max(initial=0)), 1), widest) < 1 << 62:
        apart = vectors * n - np.array(model.sums, np.int64)
    else:
        apart = vectors.astype(object) * n - np.array(model.sums, object)
    size = int(np.abs(apart).max(initial=0))
    if apart.dtype != object and size * size * apart.shape[1] >= 1 << 63:
        squares = (apart.astype(object) ** 2).sum(axis=1)
    else:
        squares = (apart**2).sum(axis=1)
    return apart.astype(np.float64) / n, [int(v) for v in squares]


def whiten(df: DataFrame, model: Whitening, keep: list[str], column: str = "vector", most: int = COMPONENTS) -> DataFrame:
    """For each row of a table of `usable` rows: the columns of `keep`, deviation decimal(38,0) and whitened array<double>.

    whitened is the vector less the mean, projected on the leading components, each over the root of its eigenvalue;
    components without variance are left out, so there may be fewer than `most`. deviation is the sum of (n*x - S)**2
    for whole numbers, exact; null for others and where it needs more than 38 digits. Vectors of another length than the
    fit's are an error.
    """
    whole, k = model.sums is not None, model.components(most)
    turn = model.vectors[:k].T / np.sqrt(model.values[:k])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart, squares = _centred(_matrix(batch.column(len(keep)), whole), model)
            flat = (apart @ turn).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k) if k else np.zeros(len(apart) + 1), pa.int32()), pa.array(flat))
            exact = pa.array([None] * len(apart) if squares is None else [Decimal(v) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], exact, lists], names=[*keep, "deviation", "whitened"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "deviation decimal(38,0)", "whitened array<double>"])
    return df.select(*keep, F.col(column).cast("array<bigint>" if whole else "array<double>").alias("v")).mapInArrow(run, schema)


def identity_error(whitened: DataFrame) -> float:
    """The largest absolute entry of the covariance of a column `whitened` minus the identity; 0 without components."""
    again = fit(whitened.where(F.size("whitened") > 0), "whitened")
    return float(np.abs(again.covariance - np.eye(len(again.covariance))).max()) if again else 0.0


def grid(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """Entries as whole numbers floor(scale * entry) + shift; null where an entry is null, not finite or beyond LIMIT."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < F.lit(float(LIMIT // 2))))
    return F.when(good, F.transform(entries, lambda c: F.floor(c * scale).cast("long") + shift))


def whitened_components(embeddings: DataFrame) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of another length than most, or holds entries that are null, not finite or beyond
    2**60 are left out; null or repeated ids are rows like others. There are fewer than COMPONENTS components where the
    covariance has no more that differ from 0 (none for a single row or equal rows). A table without such rows
    gives no rows. deviation is null where it is no long.
    """
    spark: SparkSession = embeddings.sparkSession
    rows = usable(embeddings.select("vec_id", grid(embeddings["embedding"]).alias("vector")))
    model = fit(rows)
    if model is None or not model.components():
        return spark.createDataFrame([], f"vec_id {dict(embeddings.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = written(whiten(rows, model, ["vec_id"]), "whitened")
    error, share = identity_error(out), F.array(*[F.lit(float(v)) for v in model.explained[: model.components()]])
    each = out.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
