"""Kernel regression: f(z) = K(z, Y) theta, fitted by one aggregation over the data.

Y, the centres, are bounded. With Y = X (few points) theta solves (K + reg I) theta = f;
else theta solves the normal equations, whose M x M and M x P sums are accumulated
partition by partition. Prediction is one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, maps
from ..plans.spec import KernelSpec
from . import gram, linalg
from .gram import Centres

MAX_CENTRES = 1000


def polynomial(x: np.ndarray, order: int) -> np.ndarray:
    """1, the coordinates, and their products up to the order."""
    cols, last = [np.ones((len(x), 1))], np.ones((len(x), 1))
    ends = [0] * x.shape[1]
    for _ in range(order):
        nxt, starts = [], []
        for k in range(x.shape[1]):
            starts.append(sum(m.shape[1] for m in nxt))
            nxt.append(last[:, ends[k] :] * x[:, k, None])
        last, ends = np.concatenate(nxt, 1), starts
        cols.append(last)
    return np.concatenate(cols, 1)


@dataclass(frozen=True)
class KernelModel:
    """A fitted model: specification, fitted maps, centres, coefficients; with a
    polynomial order, a regression on monomials comes first and the kernel fits the
    rest. Immutable: update() and add() give new models."""

    spec: KernelSpec
    chain: maps.MapChain
    y: Centres
    theta: np.ndarray
    beta: np.ndarray | None = None
    gram: np.ndarray | None = field(default=None, repr=False)
    rhs: np.ndarray | None = field(default=None, repr=False)

    @property
    def dim(self) -> int:
        return self.y.x.shape[1]

    def __len__(self) -> int:
        return len(self.y)

    def kernel(self, z: np.ndarray) -> np.ndarray:
        return kernels.block(self.spec, self.chain.apply(z), self.chain.apply(self.y.x))

    def values(self, z: np.ndarray) -> np.ndarray:
        out = self.kernel(z) @ self.theta
        return out if self.beta is None else out + polynomial(z, self.spec.order) @ self.beta

    def predict(self, z: DataFrame, out: str = "f") -> DataFrame:
        kind = z.schema["id"].dataType.simpleString()
        return gram.by_block(z, lambda ids, m: {"id": ids[0], out: gram._lists(self.values(m))}, f"id {kind}, {out} array<double>", len(self.y))

    __call__ = predict

    def gradients(self, z: np.ndarray) -> np.ndarray:
        """N x D x P; a map that scales (all fitted ones do) enters by its factor."""
        zs, ys = self.chain.apply(z), self.chain.apply(self.y.x)
        g = np.einsum("nmd,mp->ndp", kernels.gradient_block(self.spec, zs, ys), self.theta)
        for m in self.chain.maps:
            if m.scale:
                g = g * np.array(m.scale)[None, :, None]
        if self.chain.maps and any(not m.scale for m in self.chain.maps):
            return self._differences(z)
        if self.beta is not None:
            h = 1e-5
            for k in range(z.shape[1]):
                e = np.zeros(z.shape[1])
                e[k] = h
                g[:, k] += (polynomial(z + e, self.spec.order) - polynomial(z - e, self.spec.order)) @ self.beta / (2 * h)
        return g

    def _differences(self, z: np.ndarray, h: float = 1e-5) -> np.ndarray:
        out = []
        for k in range(z.shape[1]):
            e = np.zeros(z.shape[1])
            e[k] = h
            out.append((self.values(z + e) - self.values(z - e)) / (2 * h))
        return np.stack(out, 1)

    def grad(self, z: DataFrame) -> DataFrame:
        """(id, grad): gradient of each output as array<array<double>>, outputs outside."""
        kind = z.schema["id"].dataType.simpleString()
        return gram.by_block(z, lambda ids, m: {"id": ids[0], "grad": pa.array([g.T.tolist() for g in self.gradients(m)], pa.list_(pa.list_(pa.float64())))}, f"id {kind}, grad array<array<double>>", len(self.y) * self.dim)

    def norm(self) -> float:
        """Norm of the interpolant in the kernel's space, squared: theta' K(Y,Y) theta."""
        return float(np.einsum("mp,mp->", self.theta, self.kernel(self.y.x) @ self.theta))

    def update(self, df: DataFrame, values: list[str], reg: float | None = None) -> "KernelModel":
        """New coefficients on new data, centres kept; data seen before count too if the
        model holds its sums."""
        a, b, _ = _sums(df, values, self.spec, self.chain, self.y)
        if self.gram is not None and self.rhs is not None:
            a, b = a + self.gram, b + self.rhs
        return replace(self, theta=linalg.solve_spd(a, b, self.spec.reg if reg is None else reg), gram=a, rhs=b)

    def add(self, y: Centres) -> "KernelModel":
        """More centres with their values: the inverse of the grown Gram matrix follows
        from the old one by its Schur complement."""
        reg = self.spec.reg
        k_old = self.kernel(self.y.x) + reg * np.eye(len(self.y))
        inv = linalg.solve_spd(k_old, np.eye(len(k_old)))
        _, inv = block_inverse(inv, kernels.block(self.spec, self.chain.apply(self.y.x), self.chain.apply(y.x)), kernels.block(self.spec, self.chain.apply(y.x), self.chain.apply(y.x)) + reg * np.eye(len(y)))
        f_old = self.y.f if self.y.f is not None else self.values(self.y.x)
        both = Centres(np.concatenate([self.y.ids, y.ids]), np.concatenate([self.y.x, y.x]), np.concatenate([f_old, y.f]))
        return replace(self, y=both, theta=inv @ both.f, gram=None, rhs=None)

    def density(self, z: DataFrame) -> DataFrame:
        """(id, density): row sums of K(z, Y) K^-1 over N; not normalised."""
        k = self.kernel(self.y.x)
        w = linalg.solve_spd(k, np.ones(len(k)), max(self.spec.reg, 1e-9)) / len(k)
        kind = z.schema["id"].dataType.simpleString()
        return gram.by_block(z, lambda ids, m: {"id": ids[0], "density": pa.array(self.kernel(m) @ w)}, f"id {kind}, density double", len(self.y))

    def discrepancy(self, z: DataFrame) -> float:
        x = z.sparkSession.createDataFrame([(int(k), [float(v) for v in r]) for k, r in enumerate(self.y.x)], "id long, x array<double>")
        return gram.discrepancy(x, z, self.spec, self.chain)

    def distance(self, z: DataFrame) -> DataFrame:
        """(id, d array): kernel distance to each centre."""
        return gram.dnm(z, self.y, None, self.spec, self.chain)


def block_inverse(inv: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Schur complement, and inverse of [[A, b], [b', d]] from inv = A^-1."""
    ab = inv @ b
    s = d - b.T @ ab
    si = np.linalg.inv(s)
    return s, np.block([[inv + ab @ si @ ab.T, -ab @ si], [-si @ ab.T, si]])


def _features(spec, chain, y: Centres, n_values: int, weighted: bool):
    mapped = chain.apply(y.x)

    def features(batch: pa.RecordBatch):
        x = gram.rows_of(batch.column(0))
        f = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(n_values)], 1).astype(float) if n_values else np.zeros((len(x), 1))
        w = batch.column(1 + n_values).to_numpy(zero_copy_only=False) if weighted else None
        return kernels.block(spec, chain.apply(x), mapped), f, w

    return features


def _sums(df, values, spec, chain, y, weight=None):
    return linalg.normal_equations(df, _features(spec, chain, y, len(values), weight is not None), ["x", *values], len(y), max(1, len(values)), weight)


def fit(df: DataFrame, values: list[str], spec: KernelSpec | None = None, y: Centres | None = None, weight: str | None = None, max_centres: int = MAX_CENTRES, penalty: np.ndarray | None = None) -> KernelModel:
    """Fit on a frame (id, x, values...). y: centres; without them all points if they
    are few, else the first max_centres by id hash."""
    spec = spec or KernelSpec.default("maternnorm")
    chain = maps.fit(spec.maps, df, "x", **spec.params)
    n = df.count()
    beta = None
    if spec.order:
        width = polynomial(np.zeros((1, len(df.select("x").head()[0]))), spec.order).shape[1]

        def poly(batch):
            x = gram.rows_of(batch.column(0))
            return polynomial(x, spec.order), np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(values))], 1).astype(float), None

        a, b, _ = linalg.normal_equations(df, poly, ["x", *values], width, len(values))
        beta = linalg.solve_spd(a, b, spec.reg)
    if y is None and n <= max_centres and weight is None:
        y = gram.centres(df, values)
        k = kernels.block(spec, chain.apply(y.x), chain.apply(y.x))
        f = y.f if beta is None else y.f - polynomial(y.x, spec.order) @ beta
        r = spec.reg * np.eye(n) if penalty is None else penalty
        return KernelModel(spec, chain, y, linalg.solve_spd(k + r, f), beta)
    if y is None:
        y = gram.centres(df.orderBy(F.xxhash64("id"), "id").limit(max_centres), values)
    if beta is not None:
        names = [f"__r{k}" for k in range(len(values))]
        b = beta

        def rest(ids, m):
            f = np.stack([c.to_numpy(zero_copy_only=False) for c in ids[1:]], 1).astype(float) - polynomial(m, spec.order) @ b
            return {"id": ids[0], "x": gram._lists(m), **{n: pa.array(f[:, k]) for k, n in enumerate(names)}}

        kind = df.schema["id"].dataType.simpleString()
        df, values = gram.by_block(df, rest, f"id {kind}, x array<double>, " + ", ".join(f"{n} double" for n in names), len(beta), more=tuple(values)), names
    a, b, _ = _sums(df, values, spec, chain, y, weight)
    return KernelModel(spec, chain, y, linalg.solve_spd(a, b, spec.reg), beta, a, b)


def coefficients(df: DataFrame, values: list[str], spec: KernelSpec, y: Centres) -> np.ndarray:
    return fit(df, values, spec, y).theta


def extrapolation(df: DataFrame, values: list[str], z: DataFrame, spec: KernelSpec) -> DataFrame:
    return fit(df, values, spec).predict(z)


def interpolation(df: DataFrame, values: list[str], y: Centres, z: DataFrame, spec: KernelSpec) -> DataFrame:
    return fit(df, values, spec, y).predict(z)


def knm_inv(x: np.ndarray, y: np.ndarray, spec: KernelSpec, fx: np.ndarray | None = None) -> np.ndarray:
    """Regularised least-squares inverse of K(x, y), or its product with fx."""
    k = kernels.block(spec, x, y)
    if len(x) == len(y) and np.array_equal(x, y):
        return linalg.solve_spd(k, np.eye(len(k)) if fx is None else fx, spec.reg)
    return linalg.lstsq(k, fx, spec.reg)


def proportional_fitting(p: np.ndarray, rounds: int = 100, axis: int = 0) -> np.ndarray:
    """Alternate column and row scaling to equal sums; rows normalised last."""
    p = np.array(p, float)
    n, m = p.shape
    for _ in range(rounds):
        p = p / np.maximum(p.sum(0, keepdims=True), 1e-300) * (n / m)
        p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    return p if axis == 0 else p / p.sum(0, keepdims=True)


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class KernelClassifier:
    """Regression of log-probabilities; predictions are softmax. Targets are floored
    at 1e-9 and normalised by row in the JVM before the fit."""

    model: KernelModel

    @classmethod
    def fit(cls, df: DataFrame, probs: list[str], spec: KernelSpec | None = None, y: Centres | None = None, **more) -> "KernelClassifier":
        return cls(fit(log_probabilities(df, probs), probs, spec, y, **more))

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        return softmax(self.model.values(z))

    def predict(self, z: DataFrame) -> DataFrame:
        kind = z.schema["id"].dataType.simpleString()
        return gram.by_block(z, lambda ids, m: {"id": ids[0], "p": gram._lists(self.probabilities(m))}, f"id {kind}, p array<double>", len(self.model))

    def update(self, df: DataFrame, probs: list[str], reg: float | None = None) -> "KernelClassifier":
        return KernelClassifier(self.model.update(log_probabilities(df, probs), probs, reg))

    def gradients(self, z: np.ndarray) -> np.ndarray:
        """N x D x P: gradient of the probabilities."""
        p, g = self.probabilities(z), self.model.gradients(z)
        return p[:, None, :] * (g - np.einsum("ndp,np->nd", g, p)[..., None])


def log_probabilities(df: DataFrame, probs: list[str]) -> DataFrame:
    floored = [F.greatest(F.col(c).cast("double"), F.lit(1e-9)) for c in probs]
    total = sum(floored[1:], floored[0])
    return df.withColumns({c: F.log(v / total) for c, v in zip(probs, floored)})


def fit_multiscale(df: DataFrame, values: list[str], spec: KernelSpec, centres: Centres, max_centres: int = MAX_CENTRES):
    """Two scales: a coarse model on the centres, then one of the residuals of each cluster
    on at most max_centres of its points, from sums over all its rows (two_scale.py).
    Returns a function z -> (id, f)."""
    from . import two_scale

    return two_scale.fit(df, values, spec, centres, max_centres)


@dataclass(frozen=True)
class PolynomialRegression:
    """Least squares on monomials up to the order, fitted by one aggregation."""

    order: int
    beta: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, values: list[str], order: int = 1, eps: float = 1e-10) -> "PolynomialRegression":
        width = polynomial(np.zeros((1, len(df.select("x").head()[0]))), order).shape[1]

        def features(batch):
            return polynomial(gram.rows_of(batch.column(0)), order), np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(values))], 1).astype(float), None

        a, b, _ = linalg.normal_equations(df, features, ["x", *values], width, len(values))
        return cls(order, np.linalg.lstsq(a + eps * np.eye(width), b, rcond=None)[0])

    def predict(self, z: DataFrame) -> DataFrame:
        kind = z.schema["id"].dataType.simpleString()
        return gram.by_block(z, lambda ids, m: {"id": ids[0], "f": gram._lists(polynomial(m, self.order) @ self.beta)}, f"id {kind}, f array<double>", len(self.beta))
