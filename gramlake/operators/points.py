"""Representative points and clusters.

Greedy selection, sharp discrepancy and matching take tables of any size (selection.py);
balanced clusters are assigned in blocks. Only the chosen points reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.spec import KernelSpec
from . import gram, linalg, order, selection
from .gram import Centres
from .transport import assign


def random_points(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, by the least seeded hash: the same rows every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def first_points(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by id (what a seedless sub-sample of a matrix keeps)."""
    return df.orderBy("id").limit(n)


def greedy_select(df: DataFrame, n: int, spec: KernelSpec, block: int | None = None) -> DataFrame:
    """Rows of a greedy discrepancy selection, with their rank."""
    return df.join(selection.greedy_picks(df, n, spec, block).select("id", "rank"), "id")


def greedy_nystroem(df: DataFrame, values: list[str], n: int, spec: KernelSpec, tol: float = 1e-5, batch: int = 10, norm: str = "frobenius", start: Centres | None = None):
    """Centres added where the residual of f is largest, batch by batch, until n or the
    tolerance; each round is one aggregation (normal equations) and one scoring pass
    over all rows whose top rows alone are collected. norm: frobenius or classifier.
    Returns the fitted model."""
    from . import model

    y = start or gram.centres(df.orderBy(F.xxhash64("id"), "id").limit(batch), values)
    fitted = model.fit(df, values, spec, y)
    kind = df.schema["id"].dataType.simpleString()
    while len(y) < n:

        def residual(ids, m, fitted=fitted):
            f = np.stack([c.to_numpy(zero_copy_only=False) for c in ids[1:]], 1).astype(float)
            r = f - fitted.values(m)
            if norm == "classifier":
                r = (f.argmax(1) != fitted.values(m).argmax(1))[:, None] * (1 + np.abs(r))
            return {"id": ids[0], "e": gram.pa.array((r * r).sum(1)), "x": gram._lists(m), **{v: c for v, c in zip(values, ids[1:])}}

        schema = f"id {kind}, e double, x array<double>, " + ", ".join(f"{v} double" for v in values)
        scored = gram.by_block(df.select("id", "x", *(F.col(v).cast("double").alias(v) for v in values)), residual, schema, len(y), more=tuple(values))
        top = scored.orderBy(F.desc("e"), "id").limit(batch + len(y)).collect()
        known = set(y.ids.tolist())
        new = [r for r in top if r["id"] not in known and r["e"] > tol][: min(batch, n - len(y))]
        if not new:
            break
        y = Centres(np.concatenate([y.ids, [r["id"] for r in new]]), np.concatenate([y.x, [r["x"] for r in new]]), np.concatenate([y.f, [[r[v] for v in values] for r in new]]))
        fitted = model.fit(df, values, spec, y)
    return fitted


def match(df: DataFrame, n: int, spec: KernelSpec, rounds: int = 10, block: int | None = None) -> np.ndarray:
    """n points whose distribution is near the frame's: greedy start, then descent of the
    discrepancy to all rows. All points, if there are no more than n."""
    start, rows = selection.picked(df, n, spec, block), df.count()
    return start if n >= rows else selection.descend(df, rows, start, spec, rounds)


@dataclass
class Clusters:
    """A clustering: centres, and labels of any frame by nearest centre."""

    centres: np.ndarray
    distance: str | None = "norm2"
    spec: KernelSpec = KernelSpec("gaussian")

    def labels(self, df: DataFrame) -> DataFrame:
        return gram.labelled(df, Centres(np.arange(len(self.centres)), self.centres), self.distance, "min", self.spec)

    __call__ = labels


def kmeans(df: DataFrame, n: int, max_iter: int = 300, seed: int = 42) -> Clusters:
    data = df.select(array_to_vector("x").alias("features"))
    found = KMeans(k=min(n, df.count()), maxIter=max_iter, seed=seed, initMode="k-means||").fit(data)
    return Clusters(np.array(found.clusterCenters()))


def greedy_clusters(df: DataFrame, n: int, spec: KernelSpec) -> Clusters:
    return Clusters(selection.picked(df, n, spec), None, spec)


def sharp_clusters(df: DataFrame, n: int, spec: KernelSpec, rounds: int = 10) -> Clusters:
    return Clusters(match(df, n, spec, rounds), None, spec)


def random_clusters(df: DataFrame, n: int, spec: KernelSpec, seed: int = 42) -> Clusters:
    return Clusters(gram.centres(random_points(df, n, seed)).x, None, spec)


def balanced_labels(d: np.ndarray) -> np.ndarray:
    """Labels from a distance matrix (points x centres), sizes differing by one at most,
    least total distance: an assignment of points to repeated centres."""
    n, k = d.shape
    slots = np.arange(-(-n // k) * k) % k
    cost = d[:, slots]
    if n % k:  # rows that only the last round of slots takes, so that all others fill up
        spare = np.where(np.arange(len(slots)) < n // k * k, 1e6 * (1 + np.abs(d).max()), 0.0)
        cost = np.vstack([cost, np.tile(spare, (k - n % k, 1))])
    return slots[assign(cost)[:n]]


def two_balanced_labels(dx: np.ndarray, dy: np.ndarray, c: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Balanced labels of two sets that share clusters: alternate balanced assignments
    against the other side's costs until they stop changing."""
    k = min(dx.shape[1], dy.shape[1])
    lx, ly = balanced_labels(dx[:, :k]), balanced_labels(dy[:, :k])
    for _ in range(rounds):
        cost = dx[:, :k] + np.stack([c[:, ly == j].mean(1) if (ly == j).any() else np.zeros(len(dx)) for j in range(k)], 1)
        new_x = balanced_labels(cost)
        cost = dy[:, :k] + np.stack([c[new_x == j].mean(0) if (new_x == j).any() else np.zeros(len(dy)) for j in range(k)], 1)
        new_y = balanced_labels(cost)
        if (new_x == lx).all() and (new_y == ly).all():
            break
        lx, ly = new_x, new_y
    return lx, ly


@dataclass
class BalancedClusters:
    """Equal-size clusters of a bounded point set; other points take the label of the
    nearest of these points."""

    points: Centres
    of: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, clusters: Clusters, epsilon: float = 0.0, limit: int = 3000) -> "BalancedClusters":
        c = gram.centres(df, limit=limit)
        d = kernels.distance_block(c.x, clusters.centres, clusters.distance, clusters.spec)
        return cls(c, balanced_labels(d + epsilon * kernels.sq_dist(c.x, clusters.centres)))

    def labels(self, df: DataFrame) -> DataFrame:
        return gram.labelled(df, self.points, "norm22", labels=self.of)


#: Points that are assigned at once; one block is exact, several are approximate.
BALANCED_BLOCK = 512


def balanced_blocks(df: DataFrame, clusters: Clusters, size: int = BALANCED_BLOCK) -> DataFrame:
    """(id, label) of every row: sizes over the whole table differ by one at most.

    Rows are ranked by id hash and cut into blocks of a multiple of the clusters, each
    assigned exactly in a task of its own; only the last block can be uneven.
    """
    k = max(1, len(clusters.centres))
    size = -(-size // k) * k
    kind = df.schema["id"].dataType.simpleString()

    def assigned(table: pa.Table) -> pa.Table:
        t = table.sort_by("rank")
        d = kernels.distance_block(np.array(t.column("x").to_pylist(), float), clusters.centres, clusters.distance, clusters.spec)
        return pa.table({"id": t.column("id"), "label": pa.array(balanced_labels(d), pa.int64())})

    ranked = order.global_rank(df.select("id", "x", F.xxhash64(F.lit(42), "id").alias("h")), ["h", "id"])
    return ranked.select("id", "x", "rank", F.floor((F.col("rank") - 1) / size).alias("block")).groupBy("block").applyInArrow(assigned, f"id {kind}, label long")



def summed_gram(df: DataFrame, y: Centres, spec: KernelSpec) -> np.ndarray:
    """K(X, Y)' K(X, Y) over all rows."""
    a, _, _ = linalg.normal_equations(df, lambda b: (kernels.block(spec, gram.rows_of(b.column(0)), y.x), np.zeros((b.num_rows, 1)), None), ["x"], len(y), 1)
    return a
