"""Models of batches of games in a ring of slots, and scoring by the nearest one.

Each batch of games has a regression of its own, fitted in one distributed job for all
batches (two_scale.cluster_models: sums by batch, so a batch may hold most of the rows).
A batch takes the next slot of the ring; with all slots taken, the oldest gives way. A
point is scored by the slot that has the centre nearest to it, in one narrow pass; the
centres of all slots go to the tasks and have a checked number.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.spec import KernelSpec
from ..sources.stage import Stage
from . import gram, model, two_scale

#: Batches of one call to add(), whose names reach the driver.
MOST_BATCHES = 65_536


@dataclass(frozen=True)
class GameModels:
    """A value: add() gives a new ring."""

    values: tuple[str, ...]
    spec: KernelSpec = KernelSpec("gaussian", reg=1e-6)
    max_slots: int = 64
    most: int = 500
    slots: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict, hash=False)
    added: int = 0

    def add(self, df: DataFrame, batch: str) -> "GameModels":
        """With a model for each batch of df (x, values), in order of batch; null batches
        are left out. Of more batches than slots the last ones stay."""
        names = [r[0] for r in df.where(F.col(batch).isNotNull()).select(batch).distinct().orderBy(batch).limit(MOST_BATCHES + 1).collect()]
        if len(names) > MOST_BATCHES:
            raise ValueError(f"more than {MOST_BATCHES} batches in one call")
        if not names:
            return self
        places = {name: self.added + k for k, name in enumerate(names)}
        last = [(name, k % self.max_slots) for name, k in places.items() if k >= self.added + len(names) - self.max_slots]
        table = df.sparkSession.createDataFrame(last, f"__batch {df.schema[batch].dataType.simpleString()}, cluster long")
        values = F.array(*(F.col(v).cast("double") for v in self.values))
        routed = Stage(df.join(F.broadcast(table), F.col(batch) == F.col("__batch")).select("cluster", "x", values.alias("r"), F.xxhash64("x").alias("h")), "games")
        dim = len(routed.rows.head()["x"])
        kernel = lambda a, b: kernels.block(self.spec, a, b)
        found = two_scale.cluster_models(routed, kernel, dim, len(self.values), self.spec.reg, self.most)
        routed.drop()
        return replace(self, slots={**self.slots, **found}, added=self.added + len(names))

    def _nearest(self, m: np.ndarray) -> np.ndarray:
        """Slot of the nearest centre, the first slot on ties."""
        names = sorted(self.slots)
        return np.array(names)[np.stack([kernels.sq_dist(m, self.slots[s][0]).min(1) for s in names], 1).argmin(1)]

    def _width(self) -> int:
        return max(1, sum(len(y) for y, _ in self.slots.values()))

    def labels(self, z: DataFrame) -> DataFrame:
        """(id, label): the slot that scores each point; none without models."""
        kind = z.schema["id"].dataType.simpleString()
        if not self.slots:
            return z.select("id", F.lit(None).cast("long").alias("label"))
        return gram.by_block(z, lambda ids, m: {"id": ids[0], "label": pa.array(self._nearest(m).tolist(), pa.int64())}, f"id {kind}, label long", self._width())

    def predict(self, z: DataFrame, classes: bool = False) -> DataFrame:
        """(id, f): the nearest slot's model; classes: probabilities by softmax. Without
        models, zeros (equal probabilities)."""
        kind = z.schema["id"].dataType.simpleString()
        finish = model.softmax if classes else (lambda v: v)

        def block(ids, m):
            out = np.zeros((len(m), len(self.values)))
            at = self._nearest(m) if self.slots and len(m) else np.zeros(0, int)
            for s in np.unique(at).tolist():
                y, theta = self.slots[s]
                out[at == s] = kernels.block(self.spec, m[at == s], y) @ theta
            return {"id": ids[0], "f": gram._lists(finish(out))}

        return gram.by_block(z, block, f"id {kind}, f array<double>", self._width())
