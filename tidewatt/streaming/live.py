"""A learner that lives in a stream's state, one to a key, and the stream without repeats."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import learners


def distinct(stream: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; a key's repeats are known for `late` of event time, which bounds the state."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's rows with less than `gap` between them: start, end, n and value."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def learn(stream: DataFrame, horizons: tuple[int, ...] = (1,), warm_up: int = 1) -> DataFrame:
    """Readings (key, step, value, slot, capacity) of a stream to scored forecasts as they fall due.

    A key's learner is kept in the checkpointed state, so a lost executor replays its micro-batch only. A reading at or
    before the newest of its key is refused: repeats change nothing, and what comes late is not replayed. Conditions at a
    horizon are those of now. Within a micro-batch a key's rows are taken in order of step; null values are left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        steps, first = np.unique(rows["step"].to_numpy(), return_index=True)  # in order, the first of repeats
        newest, kept = state.get if state.exists else (None, None)
        learner = pickle.loads(kept) if kept else learners.Learner(float(rows["capacity"].iloc[first[0]]), horizons, warm_up)
        if newest is not None:
            first = first[steps > newest]
        numbers, values, at, out = rows["step"].to_numpy(), rows["value"].to_numpy(float), learners.conditions_of(rows).tolist(), []
        for i in first.tolist():
            step = int(numbers[i])
            out.extend((key[0], h, step, *rest) for h, *rest in learner.read(float(values[i]), at[i]))
            newest = step
        state.update((newest, pickle.dumps(learner)))
        if out:
            yield pd.DataFrame(out, columns=learners.COLUMNS)

    rows = stream.where("value is not null and capacity > 0")
    return rows.groupBy("key").applyInPandasWithState(run, learners.SCHEMA, "newest long, learner binary", "append", GroupStateTimeout.NoTimeout)
