"""Kernels and distances, as column expressions on two arrays and as numpy blocks.

Definitions (r the Euclidean distance): gaussian exp(-r^2); maternnorm exp(-r);
materntensor exp(-sum |d|); tensornorm prod max(0, 1-|d|); absnorm (|x|+|y|-r)/2;
multiquadricnorm (1+r^2)^-1/2; multiquadrictensor prod (1+d^2)^-1/2; sincardtensor
prod sinc d; sincardsquaretensor prod sinc^2 d; dotproduct and scalar_product <x,y>;
gaussianper prod sum_{m=-3..3} exp(-(d+m)^2); linear_regressor sum_{k<=order} <x,y>^k
(inner product of all monomials up to the order, with multiplicity).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import USER, KernelSpec, kernel_name

PERIODS = range(-3, 4)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _prod(x: Column) -> Column:
    return F.aggregate(x, F.lit(1.0), lambda a, v: a * v)


def squared_norm(x: Column) -> Column:
    return _sum(F.transform(x, lambda v: v * v))


def distance_column(x: Column, y: Column, name: str | None = "norm22", kernel: str | None = None, order: int = 1) -> Column:
    """norm1, norm2, norm22, normifty; None: k(x,x) + k(y,y) - 2 k(x,y) of the kernel."""
    if name is None:
        k = lambda a, b: kernel_column(a, b, kernel, order)
        return k(x, x) + k(y, y) - 2 * k(x, y)
    if name == "norm1":
        return _sum(F.zip_with(x, y, lambda a, b: F.abs(a - b)))
    if name == "normifty":
        return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))
    square = _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))
    if name == "norm22":
        return square
    if name == "norm2":
        return F.sqrt(square)
    raise NameError(f"unknown distance {name!r}")


def _sinc(d: Column) -> Column:
    return F.when(d == 0, F.lit(1.0)).otherwise(F.sin(d * np.pi) / (d * np.pi))


def kernel_column(x: Column, y: Column, name: str, order: int = 1) -> Column:
    name = kernel_name(name)
    if name in ("dotproduct", "scalar_product"):
        return _sum(F.zip_with(x, y, lambda a, b: a * b))
    if name == "linear_regressor":
        dot = _sum(F.zip_with(x, y, lambda a, b: a * b))
        return sum((F.pow(dot, F.lit(k)) for k in range(1, order + 1)), F.lit(1.0))
    if name == "gaussian":
        return F.exp(-distance_column(x, y, "norm22"))
    if name == "maternnorm":
        return F.exp(-distance_column(x, y, "norm2"))
    if name == "materntensor":
        return F.exp(-distance_column(x, y, "norm1"))
    if name == "tensornorm":
        return _prod(F.zip_with(x, y, lambda a, b: F.greatest(F.lit(0.0), 1 - F.abs(a - b))))
    if name == "absnorm":
        return (F.sqrt(squared_norm(x)) + F.sqrt(squared_norm(y)) - distance_column(x, y, "norm2")) / 2
    if name == "multiquadricnorm":
        return 1 / F.sqrt(1 + distance_column(x, y, "norm22"))
    if name == "multiquadrictensor":
        return _prod(F.zip_with(x, y, lambda a, b: 1 / F.sqrt(1 + (a - b) * (a - b))))
    if name == "sincardtensor":
        return _prod(F.zip_with(x, y, lambda a, b: _sinc(a - b)))
    if name == "sincardsquaretensor":
        return _prod(F.zip_with(x, y, lambda a, b: _sinc(a - b) * _sinc(a - b)))
    return _prod(F.zip_with(x, y, lambda a, b: sum((F.exp(-(a - b + m) * (a - b + m)) for m in PERIODS), F.lit(0.0))))


def sq_dist(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (-2 * x) @ y.T
    d += (x * x).sum(1)[:, None]
    d += (y * y).sum(1)[None]
    return np.maximum(d, 0.0, out=d)


def _tensor(x: np.ndarray, y: np.ndarray, f, total) -> np.ndarray:
    """Combine f(x_d - y_d) over dimensions without an N x M x D block."""
    out = None
    for k in range(x.shape[1]):
        v = f(x[:, k, None] - y[None, :, k])
        out = v if out is None else total(out, v)
    return out


def block(spec: KernelSpec | str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """K(x, y) of two blocks of (mapped) points."""
    spec = KernelSpec(spec) if isinstance(spec, str) else spec
    if spec.factors:
        a, b = spec.factors
        return block(a, x[:, : spec.split], y[:, : spec.split]) * block(b, x[:, spec.split :], y[:, spec.split :])
    name = spec.name
    if name == USER:
        return np.asarray(spec.params["k"](x, y), float)
    if name in ("dotproduct", "scalar_product"):
        return x @ y.T
    if name == "linear_regressor":
        dot = x @ y.T
        return sum(dot**k for k in range(max(1, spec.order) + 1))
    if name in ("gaussian", "maternnorm"):
        d = sq_dist(x, y)
        if name == "maternnorm":
            np.sqrt(d, out=d)
        return np.exp(np.negative(d, out=d), out=d)
    if name == "multiquadricnorm":
        return 1 / np.sqrt(1 + sq_dist(x, y))
    if name == "absnorm":
        return (np.linalg.norm(x, axis=1)[:, None] + np.linalg.norm(y, axis=1)[None] - np.sqrt(sq_dist(x, y))) / 2
    if name == "materntensor":
        return np.exp(-_tensor(x, y, np.abs, np.add))
    if name == "tensornorm":
        return _tensor(x, y, lambda d: np.maximum(0, 1 - np.abs(d)), np.multiply)
    if name == "multiquadrictensor":
        return _tensor(x, y, lambda d: 1 / np.sqrt(1 + d * d), np.multiply)
    if name == "sincardtensor":
        return _tensor(x, y, np.sinc, np.multiply)
    if name == "sincardsquaretensor":
        return _tensor(x, y, lambda d: np.sinc(d) ** 2, np.multiply)
    return _tensor(x, y, lambda d: sum(np.exp(-((d + m) ** 2)) for m in PERIODS), np.multiply)


def distance_block(x: np.ndarray, y: np.ndarray, name: str | None = "norm22", spec: KernelSpec | str | None = None) -> np.ndarray:
    if name is None:
        diag = lambda a: np.array([block(spec, r[None], r[None])[0, 0] for r in a])
        return diag(x)[:, None] + diag(y)[None] - 2 * block(spec, x, y)
    if name == "norm1":
        return _tensor(x, y, np.abs, np.add)
    if name == "normifty":
        return _tensor(x, y, np.abs, np.maximum)
    if name in ("norm2", "norm22"):
        d = sq_dist(x, y)
        return d if name == "norm22" else np.sqrt(d)
    raise NameError(f"unknown distance {name!r}")


def gradient_block(spec: KernelSpec | str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of k(x, y) in x: N x M x D. At x = y a kernel of r has gradient 0."""
    spec = KernelSpec(spec) if isinstance(spec, str) else spec
    d = x[:, None, :] - y[None]
    name = spec.name
    if spec.factors:
        a, b = spec.factors
        s = spec.split
        ka, kb = block(a, x[:, :s], y[:, :s]), block(b, x[:, s:], y[:, s:])
        return np.concatenate([gradient_block(a, x[:, :s], y[:, :s]) * kb[..., None], gradient_block(b, x[:, s:], y[:, s:]) * ka[..., None]], 2)
    if name == USER and "grad" in spec.params:
        return np.asarray(spec.params["grad"](x, y), float)
    if name in ("dotproduct", "scalar_product"):
        return np.broadcast_to(y[None], d.shape).copy()
    if name == "linear_regressor":
        dot = x @ y.T
        return sum(k * dot ** (k - 1) for k in range(1, max(1, spec.order) + 1))[..., None] * y[None]
    if name == "gaussian":
        return -2 * d * block(spec, x, y)[..., None]
    if name in ("maternnorm", "absnorm"):
        r = np.sqrt(sq_dist(x, y))
        unit = np.divide(d, r[..., None], out=np.zeros_like(d), where=r[..., None] > 1e-12)
        if name == "maternnorm":
            return -unit * block(spec, x, y)[..., None]
        nx = np.linalg.norm(x, axis=1)[:, None, None]
        return (np.divide(x[:, None, :], nx, out=np.zeros((len(x), 1, x.shape[1])), where=nx > 1e-12) - unit) / 2
    if name == "multiquadricnorm":
        return -d * block(spec, x, y)[..., None] ** 3
    if name == "materntensor":
        return -np.sign(d) * block(spec, x, y)[..., None]
    if name == "multiquadrictensor":
        return -d / (1 + d * d) * block(spec, x, y)[..., None]
    # products over dimensions without a short logarithmic form: central differences
    h, out = 1e-6, np.empty_like(d)
    for k in range(x.shape[1]):
        e = np.zeros(x.shape[1])
        e[k] = h
        out[..., k] = (block(spec, x + e, y) - block(spec, x - e, y)) / (2 * h)
    return out
