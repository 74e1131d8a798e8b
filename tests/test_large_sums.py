"""Kernel sums by features and by groups, and conditional laws on training sets of several groups."""

import numpy as np
import pytest

from gramlake.functions import kernels
from gramlake.operators import conditional, features, gram, sampling
from gramlake.plans.spec import KernelSpec

RNG = np.random.default_rng(5)


def frame(spark, x, first=0, **columns):
    names = list(columns)
    rows = [(first + k, r.tolist(), *(float(columns[n][k]) for n in names)) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["id long", "x array<double>", *(f"{n} double" for n in names)]))


@pytest.mark.parametrize("name", features.KERNELS)
def test_feature_sums_keep_their_bound(spark, name):
    x, y = RNG.normal(size=(60, 3)) * 0.6, RNG.normal(size=(400, 3)) * 0.6
    v = RNG.random(400)
    k = kernels.block(KernelSpec(name), x, y)
    got = features.sums(frame(spark, x), frame(spark, y, v=v).repartition(3), name, ["v"]).orderBy("id").collect()
    error = np.abs(np.array([r.w for r in got]) - k.sum(1))
    assert (error <= [r.bound for r in got]).all()
    assert (error <= 5 * np.array([r.se for r in got]) + 1e-9).mean() > 0.98  # and is of the size of the standard error
    assert np.abs(np.array([r.s[0] for r in got]) - k @ v).max() < 12


def test_feature_expectation_is_near_the_exact_one(spark):
    x = RNG.normal(size=(300, 2)) * 0.7
    train = frame(spark, x, v=x[:, 0] + 1)
    nw = conditional.NadarayaWatson(train, ("v",))
    exact, near = ({r.id: r.e[0] for r in nw.expectation(train, n_features=n).collect()} for n in (None, 8192))
    w = kernels.block("gaussian", x, x).sum(1)  # a ratio of sums: near where the density is well above its error
    assert max(abs(exact[k] - near[k]) for k in exact if w[k] > 50) < 0.05
    with pytest.raises(ValueError, match="no random features"):
        features.sums(train, train, "absnorm")


@pytest.mark.parametrize("points", [30, 260])
def test_sums_by_groups_and_by_stream(spark, points):
    x, y = RNG.normal(size=(points, 2)), RNG.normal(size=(250, 2))
    v = RNG.random(250)
    k = kernels.block("gaussian", x, y)
    got = gram.sums(frame(spark, x), frame(spark, y, v=v), "gaussian", ["v"], size=100, of=lambda f: np.concatenate([f, f * f], 1)).orderBy("id").collect()
    assert np.allclose([r.w for r in got], k.sum(1)) and np.allclose([r.s for r in got], np.stack([k @ v, k @ (v * v)], 1))
    same = gram.sums(frame(spark, x), frame(spark, y, v=v), "gaussian", ["v"], leave_one_out=True, size=100).orderBy("id").collect()
    for i in range(min(points, 250)):
        k[i, i] = 0
    assert np.allclose([r.w for r in same], k.sum(1))


@pytest.mark.parametrize("apart", [False, True])
def test_sums_of_a_frame_with_itself_make_each_pair_of_groups_once(spark, monkeypatch, apart):
    x, v = RNG.normal(size=(500, 3)), RNG.random(500)
    k = kernels.block("gaussian", x, x) - (np.eye(500) if apart else 0)
    cells, real = spark.sparkContext.accumulator(0), gram.tile_sums
    monkeypatch.setattr(gram, "tile_sums", lambda fun, a, b, *more: (cells.add(len(a) * len(b)), real(fun, a, b, *more))[1])
    df = frame(spark, x, v=v).repartition(3)
    got = gram.sums(df, df, "gaussian", ["v"], leave_one_out=apart, size=100, of=lambda f: np.concatenate([f, f * f], 1)).orderBy("id").collect()
    assert [r.id for r in got] == list(range(500))
    assert np.allclose([r.w for r in got], k.sum(1)) and np.allclose([r.s for r in got], np.stack([k @ v, k @ (v * v)], 1))
    alone = gram.sums(df, df, "gaussian", leave_one_out=apart, size=100).orderBy("id").collect()
    assert np.allclose([r.w for r in alone], k.sum(1))
    assert 0 < cells.value < 2 * 0.75 * 500**2
    var = conditional.NadarayaWatson(df, ("v",))
    one, many = ([r.v[0] for r in var.var(df, size=s).orderBy("id").collect()] for s in (10**6, 100))
    assert np.allclose(one, many)


@pytest.mark.parametrize("queries", [20, 250])
def test_conditional_laws_do_not_depend_on_groups(spark, queries):
    x = RNG.normal(size=(230, 2))
    train = frame(spark, x, a=RNG.random(230), b=x[:, 1])
    z = frame(spark, RNG.normal(size=(queries, 2)), first=5000)
    nw = conditional.NadarayaWatson(train, ("a", "b"))
    at = np.array([[0.2, 0.1], [0.7, -1.0], [0.5, 0.5]])
    for law, column in ((lambda s: nw.var(z, size=s), "v"), (lambda s: nw.var(z, True, size=s), "v"), (lambda s: nw.joint_density(z, at, s), "p"), (lambda s: nw.conditional_density(z, at, s), "p")):
        one, many = (np.array([r[column] for r in law(s).orderBy("id").collect()]) for s in (10**6, 100))
        assert one.shape == many.shape and np.allclose(one, many)
    one, many = (sorted(map(tuple, nw.sample(z, 7, 3, s).collect())) for s in (10**6, 100))
    assert len(one) == 7 * queries and one == many


def test_draws_follow_the_weights(spark):
    train = frame(spark, np.array([[0.0], [0.5], [1.0], [9.0]]), v=[0.0, 1.0, 2.0, 3.0])
    z = frame(spark, np.zeros((40, 1)), first=100)
    got = [r.y[0] for r in conditional.NadarayaWatson(train, ("v",)).sample(z, 250).collect()]
    w = np.exp(-np.array([0.0, 0.25, 1.0, 81.0]))
    share = np.bincount(np.array(got, int), minlength=4) / len(got)
    assert np.abs(share - w / w.sum()).max() < 0.02


def test_scattered_uniforms():
    u = sampling.scattered(np.arange(400)[:, None], np.arange(300)[None], 7)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002
    assert abs(np.corrcoef(u[:-1].ravel(), u[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.01
    assert np.histogram(u, 20)[0].std() / (u.size / 20) < 0.03
