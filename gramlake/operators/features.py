"""Kernel sums by random features: one pass over each side, with a stated error.

A kernel of differences is the mean of cos(w (x - y)) over frequencies w of a law of its
own. With D drawn frequencies, sums over y of cos(w y) and sin(w y), plain and times values,
are D numbers each, added over all rows in one pass; one pass over x then gives
sum k(x, y) at cost D a row, whatever the size of y. gram.sums is the exact way.

Each row carries its error: se is the standard error of the mean over frequencies; bound
holds with probability 1 - DELTA (empirical Bernstein inequality: the terms lie between
minus and plus the weight of y, and their variance is measured at the row).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import KernelSpec
from . import gram, sampling

FEATURES, DELTA, SEED = 4096, 1e-6, 42
KERNELS = ("gaussian", "maternnorm", "materntensor", "multiquadricnorm", "multiquadrictensor", "sincardtensor", "sincardsquaretensor")


def _uniforms(n: int, d: int, stream: int, seed: int) -> np.ndarray:
    return sampling.scattered(np.arange(n)[:, None], np.arange(d)[None], 8 * seed + stream)


def _normals(n: int, d: int, stream: int, seed: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(_uniforms(n, d, stream, seed))) * np.cos(2 * np.pi * _uniforms(n, d, stream + 1, seed))


def frequencies(spec: KernelSpec, d: int, n: int = FEATURES, seed: int = SEED) -> np.ndarray:
    """n frequencies of a kernel on d coordinates."""
    name = spec.name
    if name not in KERNELS:
        raise ValueError(f"{name} has no random features; known: {', '.join(KERNELS)}")
    if name.startswith("sincard"):
        turns = [2 * _uniforms(n, d, k, seed) - 1 for k in range(2 if name == "sincardsquaretensor" else 1)]
        return np.pi * sum(turns)
    g = _normals(n, d, 0, seed)
    if name == "gaussian":
        return np.sqrt(2) * g
    if name == "maternnorm":
        return g / np.abs(_normals(n, 1, 2, seed))  # Cauchy, one radius a frequency
    if name == "materntensor":
        return g / np.abs(_normals(n, d, 2, seed))
    return g * np.abs(_normals(n, 1 if name == "multiquadricnorm" else d, 2, seed))  # Gaussians of random width


def sums(x: DataFrame, y: DataFrame, spec: KernelSpec | str, values: list[str] | None = None, features: int = FEATURES, seed: int = SEED, delta: float = DELTA) -> DataFrame:
    """(id, w, s array, se, bound): as gram.sums, with the errors of w."""
    spec = KernelSpec(spec) if isinstance(spec, str) else spec
    values = list(values or [])
    first = y.select(F.size("x").alias("d")).head()
    width = 1 + len(values)
    w = frequencies(spec, first["d"] if first else 1, features, seed)

    def waves(points: np.ndarray, f: np.ndarray) -> np.ndarray:
        z = points @ w.T
        return np.concatenate([np.cos(z).T @ f, np.sin(z).T @ f], 1)

    def run(batches):
        total = np.zeros((features, 2 * width))
        for batch in batches:
            points = gram.rows_of(batch.column(0))
            f = np.stack([np.ones(len(points)), *(batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(values)))], 1).astype(float)
            step = max(1, gram.CELLS // features)
            for s in range(0, len(points), step):
                total += waves(points[s : s + step], f[s : s + step])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["c", "v"])

    found = y.select("x", *values).mapInArrow(run, "c long, v double").groupBy("c").agg(F.sum("v").alias("v")).toArrow()
    table = np.zeros(features * 2 * width)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    even, odd = np.split(table.reshape(features, 2 * width), 2, 1)
    mass = float(y.count())
    log = np.log(4 / delta)
    kind = x.schema["id"].dataType.simpleString()

    def block(ids, points):
        z = points @ w.T
        c, s = np.cos(z), np.sin(z)
        out = (c @ even + s @ odd) / features
        spread = np.sqrt(np.maximum((c * even[:, 0] + s * odd[:, 0]).var(1), 0))
        bound = spread * np.sqrt(2 * log / features) + 14 * mass * log / (3 * (features - 1))
        return {"id": ids[0], "w": pa.array(out[:, 0]), "s": gram._lists(out[:, 1:] if values else np.zeros((len(points), 1))), "se": pa.array(spread / np.sqrt(features)), "bound": pa.array(bound)}

    return gram.by_block(x, block, f"id {kind}, w double, s array<double>, se double, bound double", 4 * features)
