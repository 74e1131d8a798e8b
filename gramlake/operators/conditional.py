"""Conditional laws y | x: kernel-weighted averages, and transport to a latent law."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.spec import KernelSpec
from ..sources.stage import Stage
from . import features, gram, linalg, model, points, sampling
from .gram import Centres
from .transport import match_to, transition


@dataclass(frozen=True)
class NadarayaWatson:
    """E[y | x] = sum k(x, X) Y / sum k(x, X), on a training frame (id, x, values)."""

    train: DataFrame
    values: tuple[str, ...]
    spec: KernelSpec = KernelSpec("gaussian")
    spec_y: KernelSpec = KernelSpec("gaussian")

    def expectation(self, z: DataFrame, leave_one_out: bool = False, n_features: int | None = None) -> DataFrame:
        """(id, e array): training sets of any size, in passes of bounded blocks; with
        n_features by random features, one pass over each side (features.py states the error)."""
        if n_features:
            s = features.sums(z, self.train, self.spec, list(self.values), n_features)
        else:
            s = gram.sums(z, self.train, self.spec, list(self.values), leave_one_out)
        return s.select("id", F.when(F.col("w") > 0, F.transform("s", lambda v: v / F.col("w"))).alias("e"))

    __call__ = expectation

    def density(self, z: DataFrame, n_features: int | None = None) -> DataFrame:
        """(id, density): sum of k, not normalised."""
        s = features.sums(z, self.train, self.spec, None, n_features) if n_features else gram.sums(z, self.train, self.spec)
        return s.select("id", F.col("w").alias("density"))

    def residuals(self, size: int = gram.CENTRES) -> DataFrame:
        """(id, x, r0, r1, ..): training values less their expectation."""
        s = gram.sums(self.train, self.train, self.spec, list(self.values), size=size).select("id", F.transform("s", lambda v: v / F.col("w")).alias("__e"))
        left = [(F.col(v) - F.get("__e", F.lit(k))).alias(f"r{k}") for k, v in enumerate(self.values)]
        return self.train.join(s, "id").select("id", "x", *left)

    def var(self, z: DataFrame, scalar: bool = False, size: int = gram.CENTRES) -> DataFrame:
        """(id, v): weighted mean of the residuals' outer products, by rows; with scalar,
        of their squared length. Two rounds of sums over the training set."""
        r = Stage(self.residuals(size), "residuals").rows
        outer = lambda f: (f * f).sum(1, keepdims=True) if scalar else np.einsum("np,nq->npq", f, f).reshape(len(f), -1)
        s = gram.sums(r if z is self.train else z, r, self.spec, [f"r{k}" for k in range(len(self.values))], size=size, of=outer)
        return s.select("id", F.transform("s", lambda v: v / F.col("w")).alias("v"))

    def joint_density(self, z: DataFrame, y: np.ndarray, size: int = gram.CENTRES) -> DataFrame:
        """(id, p array over the given y): sum over n of kx(x, X_n) ky(y, Y_n)."""
        return self._joint(z, y, size).select("id", F.col("s").alias("p"))

    def conditional_density(self, z: DataFrame, y: np.ndarray, size: int = gram.CENTRES) -> DataFrame:
        return self._joint(z, y, size).select("id", F.transform("s", lambda v: v / F.col("w")).alias("p"))

    def _joint(self, z: DataFrame, y: np.ndarray, size: int) -> DataFrame:
        at, spec_y = np.asarray(y, float), self.spec_y
        return gram.sums(z, self.train, self.spec, list(self.values), size=size, of=lambda f: kernels.block(spec_y, f, at))

    def transition(self, z: DataFrame, y: np.ndarray) -> DataFrame:
        """(id, y_index, p): joint density scaled by columns, then by rows."""
        long = self.joint_density(z, y).select("id", F.posexplode("p").alias("y_index", "p"))
        cols = long.groupBy("y_index").agg(F.sum("p").alias("__c"))
        scaled = long.join(F.broadcast(cols), "y_index").withColumn("p", F.col("p") / F.col("__c")).drop("__c")
        return scaled.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("id"))).select("id", "y_index", "p")

    def sample(self, z: DataFrame, n: int, seed: int = 42, size: int = gram.CENTRES) -> DataFrame:
        """(id, draw, y array): n weighted draws of training values for each query.

        A race: every training row runs for each query and draw, in a time that is an
        exponential by a uniform of the three ids, over its weight; the first one is drawn.
        The first of several groups is the first of their firsts, so training sets of any
        size, groups and partitions give the same draws. The smaller side goes to the tasks.
        """
        kind, spec, width = z.schema["id"].dataType.simpleString(), self.spec, len(self.values)

        def race(zs: np.ndarray, zx: np.ndarray, ids: np.ndarray, x: np.ndarray, f: np.ndarray):
            """Of each query and draw: time, number and values of the first training row."""
            k = kernels.block(spec, zx, x)
            numbers = sampling.numbers_of(ids)
            for d in range(n):
                with np.errstate(divide="ignore"):
                    t = -np.log(sampling.scattered((zs * 1_000_003 + d)[:, None], numbers[None], seed)) / k
                at = t.argmin(1)
                yield t[np.arange(len(t)), at], numbers[at], f[at]

        schema = f"id {kind}, draw int, t double, n long, y array<double>"
        swap = self.train.count() > size >= z.count()
        if swap:
            c = gram.centres(z)
            queries = sampling.numbers_of(c.ids)

            def run(batches):
                first = [(np.full(len(c), np.inf), np.zeros(len(c), np.int64), np.zeros((len(c), width))) for _ in range(n)]
                for batch in batches:
                    ids, x = np.array(batch.column(0).to_pylist()), gram.rows_of(batch.column(1))
                    f = np.stack([batch.column(2 + j).to_numpy(zero_copy_only=False) for j in range(width)], 1).astype(float)
                    step = max(1, gram.CELLS // max(1, len(c)))
                    for s in range(0, len(x), step):
                        for (t, m, y), (t2, m2, y2) in zip(first, race(queries, c.x, ids[s : s + step], x[s : s + step], f[s : s + step])):
                            won = (t2 < t) | ((t2 == t) & (m2 < m))
                            t[won], m[won], y[won] = t2[won], m2[won], y2[won]
                for d, (t, m, y) in enumerate(first):
                    ran = np.isfinite(t)
                    yield pa.RecordBatch.from_arrays([pa.array(c.ids[ran].tolist()), pa.array(np.full(ran.sum(), d), pa.int32()), pa.array(t[ran]), pa.array(m[ran]), gram._lists(y[ran])], names=["id", "draw", "t", "n", "y"])

            runs = self.train.select("id", "x", *self.values).mapInArrow(run, schema)
        else:
            runs = None
            for group in gram.centre_groups(self.train, list(self.values), size=size):

                def block(ids, m, c=group):
                    found = list(race(sampling.numbers_of(ids[0].to_pylist()), m, c.ids, c.x, c.f))
                    t, who, y = (np.stack(v, 1).reshape(len(m) * n, *v[0].shape[1:]) for v in zip(*found))
                    return {"id": pa.array(np.repeat(np.array(ids[0].to_pylist()), n).tolist(), ids[0].type), "draw": pa.array(np.tile(np.arange(n), len(m)), pa.int32()), "t": pa.array(t), "n": pa.array(who), "y": gram._lists(y)}

                part = gram.by_block(z, block, schema, len(group))
                runs = part if runs is None else runs.unionByName(part)
        first = runs.groupBy("id", "draw").agg(F.min_by("y", F.struct("t", "n")).alias("y"))
        return first.select("id", "draw", "y")


def conditional_density_estimator(train: DataFrame, values: list[str], z: DataFrame, y: np.ndarray, spec_x: KernelSpec, spec_y: KernelSpec) -> DataFrame:
    return NadarayaWatson(train, tuple(values), spec_x, spec_y).conditional_density(z, y)


@dataclass(frozen=True)
class Sampler:
    """A generator of points like x: latent points matched to x by least-cost assignment,
    and a kernel regression from latent points to data."""

    latent: np.ndarray
    data: np.ndarray
    theta: np.ndarray
    spec: KernelSpec

    @classmethod
    def fit(cls, x: np.ndarray, spec: KernelSpec | None = None, latent_dim: int | None = None, latent: np.ndarray | None = None) -> "Sampler":
        spec = spec or KernelSpec("maternnorm", reg=1e-9)
        u = sampling.qmc_normals(len(x), latent_dim or x.shape[1], unit_variance=True) if latent is None else latent
        data = x[match_to(u, x)]
        return cls(u, data, model.knm_inv(u, u, spec, data), spec)

    def values(self, z: np.ndarray) -> np.ndarray:
        return kernels.block(self.spec, z, self.latent) @ self.theta

    def sample(self, spark, n: int, seed: int = 42) -> DataFrame:
        """(id, x array): n fresh points, made in parallel from seeded uniforms."""
        d = self.latent.shape[1]
        z = sampling.random_normals(spark, n, d, seed)
        return gram.by_block(z, lambda ids, m: {"id": ids[0], "x": gram._lists(self.values(m))}, "id long, x array<double>", len(self.latent))


@dataclass(frozen=True)
class TransportConditional:
    """y | x by a joint map from latent pairs to (x, y), regression for the mean and the
    variance, and densities by kernel projections."""

    x: np.ndarray
    y: np.ndarray
    spec: KernelSpec
    joint: Sampler
    mean: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, values: list[str], spec: KernelSpec | None = None, limit: int = 3000) -> "TransportConditional":
        spec = spec or KernelSpec("maternnorm", reg=1e-9)
        c = gram.centres(df, values, limit)
        z = (c.x - c.x.mean(0)) / np.maximum(c.x.std(0), 1e-12)
        latent = np.concatenate([z, sampling.qmc_normals(len(z), c.f.shape[1], unit_variance=True)], 1)
        xy = np.concatenate([c.x, c.f], 1)
        perm = match_to(latent, np.concatenate([z, (c.f - c.f.mean(0)) / np.maximum(c.f.std(0), 1e-12)], 1))
        joint = Sampler(latent, xy[perm], model.knm_inv(latent, latent, spec, xy[perm]), spec)
        ridge = spec.with_reg(max(spec.reg, 1e-3 * len(z)))
        mean = model.knm_inv(c.x, c.x, ridge, c.f)
        r = c.f - kernels.block(spec, c.x, c.x) @ mean
        return cls(c.x, c.f, spec, joint, mean, model.knm_inv(c.x, c.x, ridge, np.einsum("np,nq->npq", r, r).reshape(len(r), -1)))

    @classmethod
    def fit_all(cls, df: DataFrame, values: list[str], spec: KernelSpec | None = None, n: int = 500) -> "TransportConditional":
        """Fit on a table of any size. The joint map takes n points by id hash; the
        regressions for mean and variance have these as centres and sum over all rows."""
        rows, base = df.count(), cls.fit(points.random_points(df, n), values, spec)
        if rows <= n:
            return base
        x, spec = base.x, base.spec
        inner = max(spec.reg, 1e-3 * rows) * kernels.block(spec, x, x)

        def mean_part(batch):
            return kernels.block(spec, gram.rows_of(batch.column(0)), x), np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(values))], 1).astype(float), None

        a, b, _ = linalg.normal_equations(df, mean_part, ["x", *values], len(x), len(values))
        mean = linalg.solve_spd(a + inner, b, 1e-9)

        def square_part(batch):
            k, f, _ = mean_part(batch)
            r = f - k @ mean
            return k, np.einsum("np,nq->npq", r, r).reshape(len(r), -1), None

        a, b, _ = linalg.normal_equations(df, square_part, ["x", *values], len(x), len(values) ** 2)
        return cls(x, base.y, spec, base.joint, mean, linalg.solve_spd(a + inner, b, 1e-9))

    def _blocks(self, z: DataFrame, theta: np.ndarray, out: str) -> DataFrame:
        return gram.knm(z, Centres(np.arange(len(self.x)), self.x), self.spec, theta).withColumnRenamed("k", out)

    def expectation(self, z: DataFrame) -> DataFrame:
        return self._blocks(z, self.mean, "e")

    def var(self, z: DataFrame) -> DataFrame:
        return self._blocks(z, self.second, "v")

    def density(self, z: DataFrame) -> DataFrame:
        return self._blocks(z, model.knm_inv(self.x, self.x, self.spec, np.ones((len(self.x), 1))) / len(self.x), "p")

    def joint_density(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """At pairs (x_i, y_i)."""
        xy = np.concatenate([self.x, self.y], 1)
        w = model.knm_inv(xy, xy, self.spec, np.ones((len(xy), 1))) / len(xy)
        return kernels.block(self.spec, np.concatenate([x, y], 1), xy) @ w

    def transition(self, x: np.ndarray, y: np.ndarray, fx: np.ndarray | None = None) -> np.ndarray:
        """Transition matrix between two sets: projection kernels on both sides, scaled."""
        p = transition(x, self.x, self.spec) @ transition(self.y, y, self.spec)
        p = p / p.sum(1, keepdims=True)
        return p if fx is None else p @ fx

    def sample(self, z: DataFrame, n: int, seed: int = 42) -> DataFrame:
        """(id, draw, y array): for every query, n latent draws through the joint map."""
        dx, dy = self.x.shape[1], self.y.shape[1]
        mean, sd = self.x.mean(0), np.maximum(self.x.std(0), 1e-12)
        kind = z.schema["id"].dataType.simpleString()

        def block(ids, m):
            keys = ids[0].to_pylist()
            u = np.array([[sampling.uniform_of(seed, k, d * dy + j) for j in range(dy)] for k in keys for d in range(n)])
            latent = np.concatenate([np.repeat((m - mean) / sd, n, 0), sampling.normals_of(u)], 1)
            return {"id": pa.array(np.repeat(keys, n).tolist(), ids[0].type), "draw": pa.array(np.tile(np.arange(n), len(m)), pa.int32()), "y": gram._lists(self.joint.values(latent)[:, dx:])}

        return gram.by_block(z, block, f"id {kind}, draw int, y array<double>", len(self.x) * n)


#: Ranges of about equal size in which an exact quantile is looked for.
QUANTILE_RANGES = 256


def quantile_regression(df: DataFrame, value: str, probabilities: list[float], ranges: int = QUANTILE_RANGES) -> DataFrame:
    """(p, q): values at given probabilities of the empirical law, exact: the least value
    that ceil(p n) of the n values do not exceed (null, if there is none).

    A sketch only cuts the values into ranges; each is counted, and the distinct values of
    those ranges that hold a wanted place are counted and ordered, each range by itself.
    """
    v = F.col("v")
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    cuts = sorted(set(rows.select(F.percentile_approx(v, [k / ranges for k in range(1, ranges)], 1000)).head()[0] or []))
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    placed = rows.withColumn("b", F.size(F.filter(bounds, lambda c: c < v)))
    sizes = {r["b"]: r["n"] for r in placed.groupBy("b").agg(F.count("*").alias("n")).collect()}
    total, wanted = sum(sizes.values()), []
    for p in probabilities:
        place, before = max(1, math.ceil(Decimal(str(p)) * total)), 0
        for b in sorted(sizes):
            if before + sizes[b] >= place:
                wanted.append((float(p), b, place - before))
                break
            before += sizes[b]
    if not wanted:
        return df.sparkSession.createDataFrame([(float(p), None) for p in probabilities], "p double, q double")
    counted = placed.where(F.col("b").isin([b for _, b, _ in wanted])).groupBy("b", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v"))
    places = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(b).alias("b"), F.lit(k).alias("place")) for p, b, k in wanted))
    ranked = counted.withColumn("upto", upto)  # before the places multiply the rows
    found = ranked.select("b", "v", "upto", F.explode(places).alias("w")).where("w.b = b and upto >= w.place")
    return found.groupBy("w.p").agg(F.min("v").alias("q"))
