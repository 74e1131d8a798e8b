"""Draws: quasi-random and seeded pseudo-random points, weighted resampling."""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.maps import erf
from ..plans.spec import KernelSpec

_inv = np.vectorize(NormalDist().inv_cdf, otypes=[float])


def _primes(n: int) -> list[int]:
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def qmc_uniforms(n: int, d: int) -> np.ndarray:
    """Midpoints (i + 1/2) / n in one dimension, a Halton sequence in more."""
    if d == 1:
        return ((np.arange(n) + 0.5) / n)[:, None]
    out = np.empty((n, d))
    for j, p in enumerate(_primes(d)):
        i, f, v = np.arange(1, n + 1), 1.0, np.zeros(n)
        while i.any():
            f /= p
            v += f * (i % p)
            i = i // p
        out[:, j] = v
    return out


def normals_of(u: np.ndarray) -> np.ndarray:
    return _inv(np.clip(u, 1e-12, 1 - 1e-12))


def qmc_normals(n: int, d: int, unit_variance: bool = False) -> np.ndarray:
    """Normals of variance 1/2 (the default of the operator), or 1."""
    z = normals_of(qmc_uniforms(n, d))
    return z if unit_variance else z / np.sqrt(2)


def normals(n: int, d: int, rounds: int = 10, spec: KernelSpec | None = None) -> np.ndarray:
    """Low-discrepancy normals: a quasi-random start, centred to unit variance."""
    z = qmc_normals(n, d, True)
    z = z - z.mean(0)
    return z / np.maximum(z.std(0), 1e-12) if n > 1 else z


def uniforms(n: int, d: int) -> np.ndarray:
    return erf(normals(n, d)) / 2 + 0.5


def uniform_of(seed: int, key, draw: int) -> float:
    """A uniform fixed by seed, key and draw: the same on any partitioning."""
    h = hashlib.blake2b(f"{seed}:{key}:{draw}".encode(), digest_size=8).digest()
    return (int.from_bytes(h, "little") + 0.5) / 2**64


PRIME = (1 << 31) - 1


def scattered(i, j, seed: int) -> np.ndarray:
    """Uniforms in (0, 1) fixed by two whole numbers and a seed: squares and products modulo
    a prime below 2^31, so that 64-bit integers hold every step, in SQL as well."""
    i, j = np.asarray(i, np.int64) % PRIME, np.asarray(j, np.int64) % PRIME
    v = (i * 48271 + seed * 69621 + 12345) % PRIME
    v = (v * v + j) % PRIME
    v = (v * 40692 + i) % PRIME
    v = (v * v + seed) % PRIME
    v = (v * 48271 + j) % PRIME
    v = (v * v + i) % PRIME
    return (v + 0.5) / PRIME


def scattered_sql(i: str, j: str, seed: int) -> str:
    """scattered() as SQL, for whole numbers of zero or more."""
    i, j, v = f"(({i}) % {PRIME})", f"(({j}) % {PRIME})", f"(({i}) % {PRIME} * 48271 + {seed * 69621 + 12345}) % {PRIME}"
    steps = (("v * v", j), ("v * 40692", i), ("v * v", str(seed)), ("v * 48271", j), ("v * v", i))
    for product, more in steps:  # a one-element list binds v, so that squares do not double the text
        v = f"list_transform([{v}], lambda v: ({product} + {more}) % {PRIME})[1]"
    return f"(({v}) + 0.5) / {PRIME}"


def scattered_column(i: Column, j: Column, seed: int) -> Column:
    """scattered() as a column expression, for whole numbers of zero or more."""
    i, j = i.cast("long") % PRIME, j.cast("long") % PRIME
    v = (i * 48271 + (seed * 69621 + 12345)) % PRIME
    steps = (lambda v: v * v + j, lambda v: v * 40692 + i, lambda v: v * v + seed, lambda v: v * 48271 + j, lambda v: v * v + i)
    once = lambda v, step: F.transform(F.array(v), lambda x: step(x) % PRIME)[0]  # noqa: E731  v is computed once
    return (reduce(once, steps, v) + 0.5) / PRIME


def scattered_normal(i: Column, j: Column, stream: int, seed: int = 42) -> Column:
    """A standard normal fixed by two whole numbers."""
    u = lambda k: scattered_column(i, j, 8 * seed + stream + k)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1))


def numbers_of(ids) -> np.ndarray:
    """Whole numbers for ids of any type: themselves, or the CRC of their text."""
    a = np.asarray(ids)
    return a.astype(np.int64) if a.dtype.kind in "iub" else np.array([zlib.crc32(str(v).encode()) for v in a.tolist()], np.int64)


def qmc_frame(spark: SparkSession, n: int) -> DataFrame:
    """(id, u): midpoints as a frame of any size."""
    return spark.range(n).select("id", ((F.col("id") + 0.5) / n).alias("u"))


def hash_uniform(seed: int, *columns):
    """A uniform in (0, 1) fixed by the columns, in the JVM."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def random_uniforms(spark: SparkSession, n: int, d: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", F.array(*(hash_uniform(seed + k, "id") for k in range(d))).alias("x"))


def random_normals(spark: SparkSession, n: int, d: int, seed: int = 42) -> DataFrame:
    """(id, x): iid normals by Box-Muller, in the JVM."""
    pair = lambda k: F.sqrt(-2 * F.log(hash_uniform(seed + 2 * k, "id"))) * F.cos(2 * np.pi * hash_uniform(seed + 2 * k + 1, "id"))
    return spark.range(n).select("id", F.array(*(pair(k) for k in range(d))).alias("x"))


#: Rows that a bucket of weighted_resample holds, and the most buckets (their totals go to the driver).
BUCKET_ROWS, MOST_BUCKETS = 4096, 1 << 16


def weighted_resample(df: DataFrame, id_column: str, weight: str, n: int, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """(draw, id): n draws with replacement, probability by weight.

    Cumulative weights are two-level: totals of hash buckets (a small table), and a
    running sum within a bucket; each draw is sent to its bucket, then met there.
    The number of buckets follows the rows, so that a bucket stays small.
    """
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(256, -(-df.count() // BUCKET_ROWS)))
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = df.select(F.col(id_column).alias("id"), w.alias("w")).where("w > 0").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sums = rows.groupBy("b").agg(F.sum("w").alias("t")).orderBy("b").collect()
    if not sums:
        return df.sparkSession.createDataFrame([], f"draw long, id {rows.schema['id'].dataType.simpleString()}")
    tops = np.cumsum([r["t"] for r in sums])
    names = [r["b"] for r in sums]

    def place(batches):
        for batch in batches:
            u = batch.column(1).to_numpy() * tops[-1]
            k = np.minimum(np.searchsorted(tops, u, side="right"), len(tops) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(names)[k], pa.int64()), pa.array(u - np.r_[0, tops[:-1]][k])], names=["draw", "db", "u"])

    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), hash_uniform(seed, "id").alias("u")).mapInArrow(place, "draw long, db long, u double")
    run = Window.partitionBy("b").orderBy("id")
    spans = rows.select("id", "b", F.sum("w").over(run).alias("hi"), "w").withColumn("lo", F.col("hi") - F.col("w"))
    last = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("hi"), F.desc("id"))) == 1
    spans = spans.withColumn("hi", F.when(last, F.lit(float("inf"))).otherwise(F.col("hi")))
    return draws.join(spans, (F.col("db") == F.col("b")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "id")


def gumbel_pick(df: DataFrame, group: str, id_column: str, weight: str, seed: int = 42) -> DataFrame:
    """One weighted draw per group: the largest log w - log(-log u)."""
    g = F.log(F.col(weight).cast("double")) - F.log(-F.log(hash_uniform(seed, group, id_column)))
    return df.where(F.col(weight) > 0).groupBy(group).agg(F.max_by(id_column, F.struct(g.alias("g"), F.col(id_column))).alias("pick"))
