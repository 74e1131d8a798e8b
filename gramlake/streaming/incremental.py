"""Streams: model updates per micro-batch, windowed statistics with a watermark, and a
bounded replay buffer as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.model import KernelModel


class ModelStream:
    """A model that follows a stream of (id, x, values): each micro-batch adds its sums
    to the normal equations, and the coefficients are solved anew."""

    def __init__(self, model: KernelModel, values: list[str], on_update: Callable[[KernelModel, int], None] | None = None):
        self.model, self.values, self.on_update = model, values, on_update
        self.seen = -1

    def step(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.seen:  # a batch that is run again after a failure counts once
            return
        if not batch.isEmpty():
            self.model = self.model.update(batch, self.values)
        self.seen = batch_id
        if self.on_update:
            self.on_update(self.model, batch_id)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        writer = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean per key and window; rows later than the watermark are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def sessions(stream: DataFrame, ts: str, keys: list[str], value: str, gap: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def replay_buffer(stream: DataFrame, key: str, t: str, reward: str, capacity: int, gamma: float = 0.99) -> DataFrame:
    """Per key the last capacity rewards as state; every update emits (key, n, ret), the
    discounted return of what is kept, latest first."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (ts, rs) = state.get if state.exists else ([], [])
        rows = sorted([*zip(ts, rs), *((float(a), float(b)) for pdf in batches for a, b in zip(pdf["__t"], pdf["__r"]))])[-capacity:]
        state.update(([a for a, _ in rows], [b for _, b in rows]))
        g = 0.0
        for _, r in reversed(rows):
            g = r + gamma * g
        yield pd.DataFrame({key: [k[0]], "n": [len(rows)], "ret": [g]})

    rows = stream.select(key, F.col(t).cast("double").alias("__t"), F.col(reward).cast("double").alias("__r"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, ret double", "ts array<double>, rs array<double>", "update", GroupStateTimeout.NoTimeout)
