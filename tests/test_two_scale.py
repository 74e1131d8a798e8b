"""Two-scale regression against a dense twin, with a cluster that holds most rows."""

import numpy as np
import pytest

from gramlake.functions import kernels
from gramlake.operators import linalg, model, two_scale
from gramlake.operators.gram import Centres
from gramlake.plans.spec import KernelSpec

RNG = np.random.default_rng(8)
SPEC = KernelSpec("maternnorm", reg=1e-4)
CENTRES = Centres(np.arange(3), np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 5.0]]))


def table(n):
    x = np.concatenate([RNG.normal(size=(n, 2)), RNG.normal(size=(20, 2)) * 0.3 + CENTRES.x[1], RNG.normal(size=(30, 2)) * 0.3 + CENTRES.x[2]])
    return x, np.stack([np.sin(2 * x[:, 0]) + x[:, 1], x[:, 0] * x[:, 1]], 1)


def dense(coarse, x, f, fine):
    """Predictions at x with the same fine centres, in numpy."""
    at, out = kernels.sq_dist(x, CENTRES.x).argmin(1), coarse.values(x)
    r = f - out
    for c in range(3):
        s = at == c
        y = fine(c, x[s])
        k = kernels.block(SPEC, x[s], y)
        theta = linalg.solve_spd(k, r[s], SPEC.reg) if len(y) == s.sum() else linalg.solve_spd(k.T @ k, k.T @ r[s], SPEC.reg)
        out[s] += k @ theta
    return out


@pytest.mark.parametrize("most", [1000, 60])
def test_two_scales_equal_the_dense_system(spark, most):
    x, f = table(700)
    df = spark.createDataFrame([(k, x[k].tolist(), float(f[k, 0]), float(f[k, 1])) for k in range(len(x))], "id long, x array<double>, a double, b double").repartition(6)
    predict = model.fit_multiscale(df, ["a", "b"], SPEC, CENTRES, most)
    got = np.array([r.f for r in predict(df).orderBy("id").collect()])
    coarse = model.fit(df, ["a", "b"], SPEC, CENTRES)
    routed = two_scale._routed(df, ["a", "b"], coarse, CENTRES)
    sizes = routed.groupBy("cluster").count().withColumnRenamed("count", "n")
    chosen = {}
    for r in two_scale.least_hashes(routed, sizes.where(f"n > {most}"), most).orderBy("cluster", "k").collect():
        chosen.setdefault(r.cluster, []).append(r.x)
    assert all(len(v) == most for v in chosen.values()) and (not chosen) == (most > 700)
    want = dense(coarse, x, f, lambda c, rows: np.array(chosen[c]) if c in chosen else rows)
    assert np.abs(got - want).max() < 1e-5
    rms = lambda p: np.sqrt(((p - f) ** 2).mean(0))
    assert (rms(got) < (0.01 if most == 1000 else 0.5) * rms(coarse.values(x))).all()


def test_too_many_fine_centres_are_refused(spark, monkeypatch):
    monkeypatch.setattr(two_scale, "ALL_CENTRES", 10)
    x, f = table(40)
    df = spark.createDataFrame([(k, x[k].tolist(), float(f[k, 0])) for k in range(len(x))], "id long, x array<double>, a double")
    with pytest.raises(ValueError, match="fine centres"):
        model.fit_multiscale(df, ["a"], SPEC, CENTRES, 100)
