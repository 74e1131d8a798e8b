"""Maps: feature scalings, fitted by one aggregation and applied as numpy or columns.

unit cube (x - min + 1/2N) / (max - min + 1/N); std (x - mean) / population sigma;
mean distance x / sqrt(mean over all pairs of r^2) = x / sqrt(2 (E|x|^2 - |E x|^2)),
with no pair formed; min distance x / sqrt(mean of the squared distance to the
nearest other point), on a bounded number of points; grid (rank - 1/2) / N.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import map_names

#: Points that the nearest-point statistics of a map are fitted on (a documented bound).
FIT_POINTS = 1000
EDGE = 1e-9

_erf = np.vectorize(math.erf, otypes=[float])
_normal = NormalDist()
_erfinv01 = np.vectorize(lambda u: _normal.inv_cdf(min(max(u, EDGE), 1 - EDGE)) / math.sqrt(2), otypes=[float])


def erf(x: np.ndarray) -> np.ndarray:
    return _erf(x)


def erfinv_unit(u: np.ndarray) -> np.ndarray:
    """erfinv(2u - 1) for u in (0, 1)."""
    return _erfinv01(u)


@dataclass(frozen=True)
class FittedMap:
    """One map with its parameters: y = f(x * scale + shift)."""

    name: str
    scale: tuple[float, ...] = ()
    shift: tuple[float, ...] = ()

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.name == "log":
            return np.log(x)
        if self.name == "exp":
            return np.exp(x)
        if self.name == "scale_to_erf":
            return erf(x)
        if self.name == "scale_to_erfinv":
            return erfinv_unit(x)
        return x * np.array(self.scale) + np.array(self.shift or 0.0)

    def column(self, x: Column) -> Column | None:
        """The map on an array column; None if Spark has no such function."""
        if self.name == "log":
            return F.transform(x, lambda v: F.log(v))
        if self.name == "exp":
            return F.transform(x, lambda v: F.exp(v))
        if self.name in ("scale_to_erf", "scale_to_erfinv"):
            return None
        shift = self.shift or (0.0,) * len(self.scale)
        pairs = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(self.scale, shift)))
        return F.zip_with(x, pairs, lambda v, p: v * p["a"] + p["b"])


def moments(points: DataFrame, x: str = "x") -> dict[str, np.ndarray | int]:
    """Count, minimum, maximum, mean and population variance by dimension: one job
    whose result has one row a dimension."""
    rows = points.select(F.posexplode(x).alias("d", "v")).groupBy("d").agg(F.count("v"), F.min("v"), F.max("v"), F.avg("v"), F.var_pop("v")).orderBy("d").collect()
    cols = list(zip(*rows)) or [()] * 6
    return {"n": int(cols[1][0]) if rows else 0, "min": np.array(cols[2], float), "max": np.array(cols[3], float), "mean": np.array(cols[4], float), "var": np.array(cols[5], float)}


def fit_one(name: str, points: DataFrame | np.ndarray, x: str = "x", **params) -> FittedMap:
    """Fit a map on a point frame, or on an array (small inputs)."""
    if name in ("log", "exp", "scale_to_erf", "scale_to_erfinv"):
        return FittedMap(name)
    local = isinstance(points, np.ndarray)
    if local:
        m = {"n": len(points), "min": points.min(0), "max": points.max(0), "mean": points.mean(0), "var": points.var(0)}
    else:
        m = moments(points, x)
    d = len(m["min"])
    if name in ("linear_map", "affine_map"):
        return FittedMap(name, (float(params.get("a", 1.0)),) * d, (float(params.get("b", 0.0)),) * d)
    if name == "scale_factor":
        return FittedMap(name, (1 / float(params.get("h", params.get("bandwidth", 1.0))),) * d)
    if name == "scale_std":
        sd = np.sqrt(m["var"])
        scale = np.divide(1.0, sd, out=np.zeros(d), where=sd > 0)
        return FittedMap(name, tuple(scale), tuple(-m["mean"] * scale))
    if name in ("scale_to_unitcube", "map_to_grid"):
        n = m["n"]
        span = m["max"] - m["min"]
        scale = np.where(span > 0, 1 / (span + 1 / n), 0.0)
        return FittedMap(name, tuple(scale), tuple(np.where(span > 0, (0.5 / n - m["min"]) * scale, 0.5)))
    if name == "scale_to_mean_distance":
        alpha = 2 * m["var"].sum()
    else:
        pts = points if local else np.array([r[0] for r in points.select(x).orderBy(F.xxhash64(x), x).limit(FIT_POINTS).collect()])
        pts = pts[:FIT_POINTS]
        g = ((pts * pts).sum(1)[:, None] + (pts * pts).sum(1)[None] - 2 * pts @ pts.T) if len(pts) > 1 else np.ones((1, 1))
        np.fill_diagonal(g, np.inf if len(pts) > 1 else 1.0)
        alpha = np.maximum(g.min(1), 0).mean()
    return FittedMap(name, (1 / math.sqrt(alpha) if alpha > 0 else 1.0,) * d)


@dataclass(frozen=True)
class MapChain:
    maps: tuple[FittedMap, ...] = ()

    def apply(self, x: np.ndarray) -> np.ndarray:
        for m in self.maps:
            x = m.apply(x)
        return x

    def column(self, x: Column) -> Column:
        for m in self.maps:
            x = m.column(x)
            if x is None:
                raise NotImplementedError(f"{m.name} has no column form; use apply()")
        return x


def mapped(points: DataFrame, m: FittedMap, x: str = "x") -> DataFrame:
    """The points (x alone) through a map, block by block in numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            flat = m.apply(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)).ravel() if len(rows) else np.zeros(0)
            width = len(flat) // max(len(rows), 1)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(flat))], names=[x])

    return points.select(F.col(x).cast("array<double>").alias(x)).mapInArrow(run, f"`{x}` array<double>")


def fit(names, points: DataFrame | np.ndarray, x: str = "x", **params) -> MapChain:
    """Fit a chain: each map on what those before it give, over all rows."""
    out: list[FittedMap] = []
    at = points
    for name in map_names(names):
        m = fit_one(name, at, x, **params)
        out.append(m)
        if isinstance(at, np.ndarray):
            at = m.apply(at)
        elif m.name in ("scale_to_erf", "scale_to_erfinv"):
            at = mapped(at, m, x)
        else:
            at = at.withColumn(x, m.column(F.col(x)))
    return MapChain(tuple(out))


def grid_ranks(df: DataFrame, column: str, out: str = "grid") -> DataFrame:
    """Rank midpoint (rank - 1/2) / N of a column; ranks come from one range-partitioned
    sort with per-partition offsets, not from one task."""
    from ..operators.order import global_rank

    n = df.count()
    return global_rank(df, [column], "__rank").withColumn(out, (F.col("__rank") - 0.5) / n).drop("__rank")


def window_scale(df: DataFrame, column: str, kind: str, out: str) -> DataFrame:
    """std, unitcube or meandistance of one column; the statistics are one aggregated
    row that is broadcast."""
    c = F.col(column)
    stats = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"), F.avg(c).alias("__mean"), F.var_pop(c).alias("__var"), F.count(c).alias("__n"))
    lo, hi, mean, var, n = (F.col(k) for k in ("__lo", "__hi", "__mean", "__var", "__n"))
    value = {
        "std": F.when(var > 0, (c - mean) / F.sqrt(var)).otherwise(0.0),
        "unitcube": F.when(hi > lo, (c - lo + 0.5 / n) / (hi - lo + 1 / n)).otherwise(0.5),
        "meandistance": F.when(var > 0, c / F.sqrt(2 * var)).otherwise(c),
    }[kind]
    return df.join(F.broadcast(stats)).withColumn(out, value).drop("__lo", "__hi", "__mean", "__var", "__n")


