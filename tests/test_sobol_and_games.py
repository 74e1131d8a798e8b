"""Digital nets, and models of batches of games against dense fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.functions import kernels
from gramlake.operators import game_models, linalg, sampling, sobol
from gramlake.plans.spec import KernelSpec


@pytest.mark.parametrize("seed", [None, 42, 7])
def test_digital_net(spark, seed):
    d, k = 6, 7
    rows = spark.range(1 << k).select(*(sobol.coordinate(F.col("id"), j, seed).alias(f"u{j}") for j in range(d))).collect()
    u = np.array(rows)
    assert u.min() >= 0 and u.max() < 1
    for j in range(d):  # one point in each interval of 2^-k
        assert sorted(np.floor(u[:, j] * (1 << k)).astype(int)) == list(range(1 << k))
    for a in range(k + 1):  # and of the first two coordinates in each box of that volume
        boxes = {(int(x * (1 << a)), int(y * (1 << (k - a)))) for x, y in u[:, :2]}
        assert len(boxes) == 1 << k
    if seed is not None:
        other = np.array(spark.range(1 << k).select(sobol.coordinate(F.col("id"), 0, seed + 1)).collect())[:, 0]
        assert not np.allclose(other, u[:, 0])


def test_primitive_polynomials():
    assert [p for p, _ in sobol.polynomials(7)] == [3, 7, 11, 13, 19, 25, 37]


def test_points_go_with_ranks(spark):
    df = spark.createDataFrame([(k * 10, "x") for k in range(50)], "k long, u string").repartition(7)
    rows = sobol.attached(df.drop("u"), "k", 2).collect()
    want = [r[0] for r in spark.range(50).select(F.array(*(sobol.coordinate(F.col("id"), j) for j in range(2)))).collect()]
    assert {r.k // 10: r.u for r in rows} == dict(enumerate(want))


def test_columns_equal_arrays(spark):
    got = [r[0] for r in spark.range(200).select(sampling.scattered_column(F.col("id") * 12_345_678_901, F.lit(5), 9)).collect()]
    assert got == sampling.scattered(np.arange(200) * 12_345_678_901, 5, 9).tolist()
    z = [r[0] for r in spark.range(4000).select(sampling.scattered_normal(F.col("id"), F.lit(1), 0)).collect()]
    assert abs(np.mean(z)) < 0.06 and abs(np.std(z) - 1) < 0.05


def games(n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)) + np.array([[0, 0], [5, 0], [0, 5]])[np.arange(n) % 3]
    return x, np.sin(x[:, 0]) + x[:, 1], np.arange(n) % 3


@pytest.mark.parametrize("most", [1000, 50])
def test_ring_of_models_equals_dense_fits(spark, most):
    x, f, b = games(600, 1)
    df = spark.createDataFrame([(x[k].tolist(), float(f[k]), int(b[k])) for k in range(600)] + [([0.0, 0.0], 1.0, None)], "x array<double>, v double, b int").repartition(4)
    spec = KernelSpec("gaussian", reg=1e-3)
    ring = game_models.GameModels(("v",), spec, most=most).add(df, "b")
    assert sorted(ring.slots) == [0, 1, 2] and ring.added == 3
    z = np.random.default_rng(2).normal(size=(80, 2)) * 3
    zs = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(z)], "id long, x array<double>")
    at = {r.id: r.label for r in ring.labels(zs).collect()}
    got = {r.id: r.f[0] for r in ring.predict(zs).collect()}
    for k in range(80):
        near = [kernels.sq_dist(z[k][None], ring.slots[s][0]).min() for s in range(3)]
        assert at[k] == int(np.argmin(near))
        s = b == at[k]
        y = ring.slots[at[k]][0]
        m = kernels.block(spec, x[s], y)
        theta = linalg.solve_spd(kernels.block(spec, y, y), f[s][np.lexsort(x[s].T[::-1])], 1e-3) if most == 1000 else linalg.solve_spd(m.T @ m, m.T @ f[s], 1e-3)
        assert got[k] == pytest.approx(float(kernels.block(spec, z[k][None], y)[0] @ theta), abs=1e-6)


def test_oldest_slots_give_way(spark):
    x, f, b = games(90, 3)
    part = lambda names: spark.createDataFrame([(x[k].tolist(), float(f[k]), int(b[k]) + names) for k in range(90)], "x array<double>, v double, b int")
    one = game_models.GameModels(("v",), max_slots=4).add(part(0), "b")
    two = one.add(part(10), "b")
    assert sorted(two.slots) == [0, 1, 2, 3] and two.added == 6
    assert two.slots[2] is one.slots[2] and two.slots[0] is not one.slots[0]  # slots 3, 0 and 1 are new
    many = game_models.GameModels(("v",), max_slots=2).add(part(0), "b")
    assert sorted(many.slots) == [0, 1]
    none = game_models.GameModels(("v", "w"))
    z = spark.createDataFrame([(1, [0.0, 0.0])], "id long, x array<double>")
    assert none.predict(z, classes=True).head()["f"] == [0.5, 0.5] and none.labels(z).head()["label"] is None
    assert none.add(part(0).limit(0).withColumn("w", F.lit(0.0)), "b") is none
