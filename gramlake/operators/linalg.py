"""Dense linear algebra: small matrices on the driver, tall ones by aggregation."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest matrix that is solved on the driver.
DRIVER_ROWS = 4096


def checked(a: np.ndarray) -> np.ndarray:
    if max(a.shape) > DRIVER_ROWS and a.ndim == 2 and min(a.shape) > DRIVER_ROWS:
        raise ValueError(f"{a.shape} is too large for the driver; at most {DRIVER_ROWS}")
    return np.asarray(a, float)


def coo(df: DataFrame, row: str, array: str) -> DataFrame:
    """Rows of arrays as (i, j, v)."""
    return df.select(F.col(row).alias("i"), F.posexplode(array).alias("j", "v"))


def prod(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two (i, j, v) matrices."""
    r = b.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("v").alias("bv"))
    return a.join(r, F.col("j") == F.col("bi")).groupBy("i", F.col("bj").alias("j")).agg(F.sum(F.col("v") * F.col("bv")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def scalar_product(a: DataFrame, b: DataFrame, key: str = "i", v: str = "v") -> DataFrame:
    r = b.select(F.col(key).alias("__k"), F.col(v).alias("__v"))
    return a.join(r, F.col(key) == F.col("__k")).agg(F.sum(F.col(v) * F.col("__v")).alias("product"))


def prod_vector_matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Batched product: one matrix product per leading index."""
    return np.einsum("n...j,njk->n...k", x, y)


def cholesky(a: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(checked(a))


def cholesky_inverse(a: np.ndarray, eps: float = 0.0) -> np.ndarray:
    c = np.linalg.inv(cholesky(a + eps * np.eye(len(a))))
    return c.T @ c


def inverse(a: np.ndarray) -> np.ndarray:
    return np.linalg.inv(checked(a))


def polar(a: np.ndarray, eps: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A = U P with U orthogonal and P symmetric positive."""
    u, s, vt = np.linalg.svd(checked(a) + eps * np.eye(*a.shape), full_matrices=False)
    return u @ vt, vt.T @ np.diag(s) @ vt


def svd(a: np.ndarray, eps: float = 0.0):
    return np.linalg.svd(checked(a) + eps * np.eye(*a.shape), full_matrices=False)


def eigh(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, values) of a symmetric matrix."""
    values, vectors = np.linalg.eigh(checked(a))
    return vectors, values


def nearest_positive(a: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """Eigenvalues below eps raised to it."""
    vectors, values = eigh((a + a.T) / 2)
    return vectors @ np.diag(np.maximum(values, eps)) @ vectors.T


def solve_spd(a: np.ndarray, b: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """(A + eps I)^-1 b by Cholesky, by least squares if that fails."""
    m = checked(a) + eps * np.eye(len(a))
    try:
        c = np.linalg.cholesky(m)
        return np.linalg.solve(c.T, np.linalg.solve(c, b))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(m, b, rcond=None)[0]


def lstsq(a: np.ndarray, b: np.ndarray | None = None, eps: float = 1e-8) -> np.ndarray:
    """(A'A + eps I)^-1 A' b; without b the pseudo-inverse."""
    return solve_spd(a.T @ a, a.T if b is None else a.T @ b, eps)


def vandermonde(x: np.ndarray, y: np.ndarray, exact: bool = False) -> np.ndarray:
    """Weights w with sum_j w_j x_j^k = y_k; one system per row of a matrix x. With exact in
    rational arithmetic (an array of fractions), for nodes so near each other that weights
    rounded to doubles no longer meet y."""
    x = np.atleast_2d(np.asarray(x, float))
    out = np.array([_rational_weights(r, y) if exact else np.linalg.solve(np.vander(r, increasing=True).T, y) for r in x])
    return out[0] if len(out) == 1 else out


def _rational_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The method of Bjorck and Pereyra, over fractions."""
    x, w, n = fractions(x), fractions(y), len(x)
    if len(set(x)) < n:
        raise np.linalg.LinAlgError("equal nodes")
    for k in range(n - 1):
        for i in range(n - 1, k, -1):
            w[i] -= x[k] * w[i - 1]
    for k in range(n - 2, -1, -1):
        for i in range(k + 1, n):
            w[i] /= x[i] - x[i - k - 1]
        for i in range(k, n - 1):
            w[i] -= w[i + 1]
    return w


def fractions(x: np.ndarray) -> np.ndarray:
    """Doubles as the fractions that they are."""
    return np.array([Fraction(float(v)) for v in x], dtype=object)


def theta_scheme(a: np.ndarray, dt: float, u0: np.ndarray, theta: float = 0.5) -> np.ndarray:
    """One step of du/dt = A u: (I - theta dt A) u1 = (I + (1 - theta) dt A) u0."""
    i = np.eye(len(a))
    return np.linalg.solve(i - theta * dt * a, (i + (1 - theta) * dt * a) @ u0)


def sqrt_spd(a: np.ndarray) -> np.ndarray:
    vectors, values = eigh(a)
    return vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T


def normal_equations(df: DataFrame, features, arrays: list[str], width: int, outputs: int, weight: str | None = None, piece: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of A'A (width x width) and A'b over all rows: a partial sum per partition,
    then one mergeable sum per cell. features: batch -> (A, b), of piece rows at most."""
    cells = width * width + width * outputs + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ata, atb, n = np.zeros((width, width)), np.zeros((width, outputs)), 0
        for batch in batches:
            step = piece or max(1, 2_000_000 // width)
            for s in range(0, batch.num_rows, step):
                a, b, w = features(batch.slice(s, step))
                left = a if w is None else a * w[:, None]
                ata += left.T @ a
                atb += left.T @ b
                n += len(a)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(np.concatenate([ata.ravel(), atb.ravel(), [n]]))], names=["c", "v"])

    found = df.select(*arrays, *([weight] if weight else [])).mapInArrow(run, "c long, v double").groupBy("c").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(cells)
    flat[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return flat[: width * width].reshape(width, width), flat[width * width : -1].reshape(width, outputs), int(flat[-1])


def fit_to_cov(df: DataFrame, columns: list[str], cov: np.ndarray) -> DataFrame:
    """Columns standardised, given a covariance, and shifted back to their means."""
    stats = df.agg(*(f(c) for c in columns for f in (F.avg, F.stddev_pop))).head()
    means, sds, root = stats[::2], stats[1::2], sqrt_spd(np.asarray(cov, float))
    z = [(F.col(c) - m) / s if s else F.lit(0.0) for c, m, s in zip(columns, means, sds)]
    return df.withColumns({c: sum((z[k] * float(root[k, j]) for k in range(len(z))), F.lit(0.0)) + means[j] for j, c in enumerate(columns)})
