"""The reverse-mode tape against derivatives worked out by hand."""

import numpy as np
import pytest

from gramlake.operators import differential, tape

X = np.random.default_rng(2).normal(size=(7, 3))
A = np.random.default_rng(3).normal(size=(3, 3))


def close(a, b):
    return np.allclose(a, b, rtol=0, atol=1e-12 * max(1, np.abs(b).max()))


def test_polynomials_are_exact():
    f = lambda x: x[:, 0] ** 3 * x[:, 1] - 2 * x[:, 2] ** 2 + (x @ A.T * x).sum(1) / 3
    a, b, c = X.T
    s = (A + A.T) / 3
    want = np.stack([3 * a * a * b, a**3, -4 * c], 1) + X @ s
    assert close(tape.nabla(f, X), want)
    h = np.zeros((7, 3, 3)) + s
    h[:, 0, 0] += 6 * a * b
    h[:, 0, 1] += 3 * a * a
    h[:, 1, 0] += 3 * a * a
    h[:, 2, 2] -= 4
    assert close(tape.hessian(f, X), h) and close(tape.laplace(f, X), np.trace(h, axis1=1, axis2=2))


def test_fields():
    f = lambda x: np.stack([x[:, 0] * x[:, 1], x[:, 2] ** 2, x[:, 1] + 5], 1)
    a, b, c = X.T
    z, o = np.zeros(7), np.ones(7)
    want = np.stack([np.stack([b, a, z], 1), np.stack([z, z, 2 * c], 1), np.stack([z, o, z], 1)], 1)
    assert close(tape.jacobian(f, X), want) and close(tape.divergence(f, X), b)


@pytest.mark.parametrize("f, g", [
    (lambda x: np.exp(x).sum(1), lambda x: np.exp(x)),
    (lambda x: np.log(x * x + 1).sum(1), lambda x: 2 * x / (x * x + 1)),
    (lambda x: np.sqrt(1 + (x**2).sum(1)), lambda x: x / np.sqrt(1 + (x**2).sum(1, keepdims=True))),
    (lambda x: (np.sin(x) * np.cos(x)).sum(1), lambda x: np.cos(2 * x)),
    (lambda x: np.tanh(x).mean(1), lambda x: (1 - np.tanh(x) ** 2) / 3),
    (lambda x: np.abs(x).sum(1) + np.maximum(x, 0.5).sum(1) - np.minimum(0, x).sum(1), lambda x: np.sign(x) + (x >= 0.5) - (x < 0)),
    (lambda x: 2 ** x[:, 0] / (3 - x[:, 1]) ** 2, lambda x: np.stack([np.log(2) * 2 ** x[:, 0] / (3 - x[:, 1]) ** 2, 2 * 2 ** x[:, 0] / (3 - x[:, 1]) ** 3, 0 * x[:, 0]], 1)),
    (lambda x: np.sum(x[:, [0, 0, 2]], axis=1), lambda x: np.broadcast_to([2.0, 0, 1], x.shape)),
    (lambda x: (x @ np.array([1.0, 2, 3])) ** 2, lambda x: 2 * (x @ np.array([[1.0], [2], [3]])) * np.array([[1.0, 2, 3]])),
])
def test_functions(f, g):
    assert np.allclose(tape.nabla(f, X), g(X), rtol=1e-12, atol=1e-12)
    assert np.allclose(f(tape.Tape(X)).value, f(X))  # the tape computes what numpy does


def test_constants_and_unknown_functions():
    assert not tape.nabla(lambda x: np.ones(len(x.value)), X).any() and not tape.hessian(lambda x: np.ones(7), X).any()
    assert not tape.laplace(lambda x: x.sum(1), X).any() and not tape.nabla(lambda x: x[:, 0] ** 0, X).any()
    with pytest.raises(TypeError, match="no rule"):
        tape.nabla(lambda x: np.arctan(x).sum(1), X)


def test_taylor_of_a_quadratic_is_exact():
    f = lambda x: (x @ A * x).sum(1) + x[:, 0]
    z = X + 0.1
    assert np.allclose(differential.taylor_of(f, X, z), f(z)) and not np.allclose(differential.taylor_of(f, X, z, 1), f(z))


def test_over_a_frame(spark):
    df = spark.createDataFrame([(f"p{k}", r.tolist()) for k, r in enumerate(X)], "id string, x array<double>").repartition(3)
    got = {r.id: r.g for r in tape.over(df, lambda x: (x**3).sum(1), "hessian").collect()}
    assert all(np.allclose(np.reshape(got[f"p{k}"], (3, 3)), np.diag(6 * r)) for k, r in enumerate(X))
    assert tape.over(df.limit(0), lambda x: x.sum(1)).count() == 0
