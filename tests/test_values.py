"""Queries without SQL against numpy twins on their full results."""

import duckdb
import numpy as np
import pytest

from gramlake.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data():
    rows = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    x = np.array([r[1] for r in rows], float)
    means = np.array([x[[r[2] == k for r in rows]].mean(0) for k in range(10)])
    f = np.sin(3 * x[:, 0]) + x[:, 1] * x[:, 2]
    return np.array([r[0] for r in rows]), x, f, means


def result(spark, name, column, key="id"):
    return {r[key]: r[column] for r in queries.QUERIES[name](spark, SF).collect()}


def near(got, ids, want, atol):
    assert len(got) == len(ids)
    assert np.abs(np.array([got[i] for i in ids.tolist()]) - want).max() <= atol


def scaled(x):
    """By the root of the mean squared distance of all pairs."""
    return x / np.sqrt(2 * ((x**2).sum(1).mean() - (x.mean(0) ** 2).sum()))


def distances(a, b):
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def test_kernel_regression(spark, data):
    ids, x, f, _ = data
    k = np.exp(-distances(scaled(x), scaled(x)))
    near(result(spark, "kernel_regression", "p"), ids, k @ np.linalg.solve(k + 1e-6 * np.eye(len(k)), f), 2e-4)
    near(result(spark, "kernel_regression", "f"), ids, f, 6e-5)


def test_kernel_regression_update(spark, data):
    ids, x, f, means = data
    s = np.sqrt(2 * ((x**2).sum(1).mean() - (x.mean(0) ** 2).sum()))
    k = np.exp(-distances(x / s, means / s))
    theta = np.linalg.solve(2 * k.T @ k + 1e-6 * np.eye(10), k.T @ f + 2 * k.T @ f)  # both passes count
    near(result(spark, "kernel_regression_update", "p"), ids, k @ theta, 2e-3)


def test_kernel_classifier(spark, data):
    ids, x, f, _ = data
    p = np.stack([f > 0, f <= 0], 1).astype(float)
    logs = np.log(np.maximum(p, 1e-9) / np.maximum(p, 1e-9).sum(1, keepdims=True))
    k = np.exp(-distances(scaled(x), scaled(x)))
    e = np.exp(k @ np.linalg.solve(k + 1e-4 * np.eye(len(k)), logs))
    near(result(spark, "kernel_classifier", "p1"), ids, e[:, 0] / e.sum(1), 2e-4)


def test_kernel_gradient(spark, data):
    ids, x, f, _ = data
    s = np.sqrt(2 * ((x**2).sum(1).mean() - (x.mean(0) ** 2).sum()))
    k = lambda a: np.exp(-distances(a / s, x / s) ** 2)
    theta = np.linalg.solve(k(x) + 1e-6 * np.eye(len(x)), f)
    h = np.zeros(64)
    h[0] = 1e-4
    near(result(spark, "kernel_gradient", "d0"), ids, (k(x + h) @ theta - k(x - h) @ theta) / 2e-4, 2e-2)


def test_kernel_density(spark, data):
    ids, x, _, means = data
    inner = np.exp(-distances(means, means) ** 2) + 1e-6 * np.eye(10)
    near(result(spark, "kernel_density", "density"), ids, np.exp(-distances(x, means) ** 2) @ np.linalg.solve(inner, np.ones(10)) / 10, 1e-4)


def test_map_standard_mean(spark, data):
    from statistics import NormalDist

    ids, x, _, _ = data
    n = len(x)
    u = (x - x.min(0) + 0.5 / n) / (x.max(0) - x.min(0) + 1 / n)
    z = scaled(np.vectorize(NormalDist().inv_cdf)(u) / np.sqrt(2))
    near(result(spark, "map_standard_mean", "total"), ids, z.sum(1), 1e-4)


def test_sharp_clusters_and_matched_points(spark, data):
    ids, x, _, _ = data
    k = lambda a, b: np.exp(-distances(a, b) ** 2)
    loss = lambda y: k(y, y).mean() - 2 * k(y, x).mean()
    picked = []
    for _ in range(10):
        left = [i for i in range(len(x)) if i not in picked]
        picked.append(min(left, key=lambda i: (round(loss(x[[*picked, i]]), 12), i)))
    got = queries.QUERIES["matched_points"](spark, SF).orderBy("i").collect()
    assert len(got) == 10  # descent moves the picks by little, and never away from the points' distribution
    assert np.abs(np.array([r.x0 for r in got]) - x[picked][:, 0]).max() < 0.5
    labels = result(spark, "sharp_cluster_labels", "label")
    assert set(labels) == set(ids.tolist()) and set(labels.values()) <= set(range(8)) and len(set(labels.values())) > 4


def test_kmeans_lowers_the_spread(spark, data):
    ids, x, _, _ = data
    labels = result(spark, "kmeans_clusters", "label")
    at = np.array([labels[i] for i in ids.tolist()])
    centres = np.array([x[at == c].mean(0) for c in np.unique(at)])
    assert (distances(x, centres).argmin(1) == np.searchsorted(np.unique(at), at)).mean() > 0.99  # a fixed point
    assert (distances(x, centres).min(1) ** 2).sum() < ((x - x.mean(0)) ** 2).sum()


def test_weighted_resample_takes_positive_balances(spark):
    rows = queries.QUERIES["weighted_resample"](spark, SF).collect()
    weights = dict(duckdb.sql(f"select c_custkey, c_acctbal from '{SF}/customer.parquet'").fetchall())
    assert len(rows) == 1000 and sorted(r.draw for r in rows) == list(range(1000)) and all(weights[r.id] > 0 for r in rows)
    mean = np.mean([weights[r.id] for r in rows])
    w = np.array([v for v in weights.values() if v > 0])
    assert mean == pytest.approx((w * w).sum() / w.sum(), rel=0.1)


def test_quantiles_of_many_values_are_exact(spark, tmp_path):
    import os

    rows = spark.range(60_000, numPartitions=7).selectExpr("id as s_suppkey", "round(pmod(xxhash64(id), 1000000) / 100 - 1000, 2) as s_acctbal")
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    files = [f"{tmp_path}/supplier.parquet/{f}" for f in os.listdir(f"{tmp_path}/supplier.parquet") if f.endswith(".parquet")]
    db = duckdb.connect()
    db.execute(f"create view supplier as select * from read_parquet({files})")
    got = {r.p: r.q for r in queries.QUERIES["quantile_values"](spark, str(tmp_path)).collect()}
    assert got == dict(db.sql(queries.ORACLES["quantile_values"]).fetchall())


def test_quantiles_of_ties_nulls_and_nothing(spark):
    from gramlake.operators import conditional

    of = lambda values, ps: {r.p: r.q for r in conditional.quantile_regression(spark.createDataFrame([(v,) for v in values], "v double"), "v", ps, 4).collect()}
    assert of([5.0] * 9 + [7.0], [0.0, 0.1, 0.9, 0.91, 1.0]) == {0.0: 5.0, 0.1: 5.0, 0.9: 5.0, 0.91: 7.0, 1.0: 7.0}
    assert of([None, 2.0, None, 1.0], [0.5, 0.51]) == {0.5: 1.0, 0.51: 2.0}
    assert of([None], [0.5]) == of([], [0.5]) == {0.5: None}


def test_weights_on_near_nodes_meet_their_moments():
    from gramlake.operators import linalg

    x, y = np.sqrt(np.array([780.1, 783.4, 785.2, 789.9])), np.array([60.5, -12.25, 3.0, 9.5])
    near = np.vander(x, increasing=True).T @ linalg.vandermonde(x, y)
    assert np.abs(near - y).max() > 1e-6  # in doubles the moments are missed
    back = np.vander(linalg.fractions(x), increasing=True).T @ linalg.vandermonde(x, y, exact=True)
    assert back.astype(float).tolist() == y.tolist()
    assert np.allclose(linalg.vandermonde([[1, 2, 4], [0, 1, 3]], y[:3], exact=True).astype(float), linalg.vandermonde([[1, 2, 4], [0, 1, 3]], y[:3]))
    with pytest.raises(np.linalg.LinAlgError):
        linalg.vandermonde([1, 1], [1, 2], exact=True)


def test_factors_of_a_larger_table_are_exact(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(50_000, 64)) / 8
    spark.createDataFrame([(k, r.tolist(), 0) for k, r in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.factor: r for r in queries.QUERIES["matrix_factors"](spark, str(tmp_path)).collect()}
    assert all(r.exact for r in got.values())
    assert abs(got["vandermonde"].total - x.astype(np.float32).astype(float)[:, :4].sum()) < 1e-3
