"""Greedy selection, matching and sharp discrepancy on tables of several blocks."""

import numpy as np
import pytest

from gramlake.functions import kernels
from gramlake.operators import points, selection
from gramlake.plans.spec import KernelSpec

RNG = np.random.default_rng(11)
SPEC = KernelSpec("gaussian")


def frame(spark, x, parts=5):
    return spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, x array<double>").repartition(parts)


def mmd(y, x, spec=SPEC):
    return kernels.block(spec, y, y).mean() - 2 * kernels.block(spec, y, x).mean() + kernels.block(spec, x, x).mean()


@pytest.mark.parametrize("parts", [1, 7])
def test_one_block_is_the_exact_choice(spark, parts):
    x = RNG.normal(size=(300, 3))
    got = selection.greedy_picks(frame(spark, x, parts), 12, SPEC).orderBy("rank").collect()
    assert [r.id for r in got] == selection.greedy_discrepancy(x, 12, SPEC).tolist() and [r.rank for r in got] == list(range(12))


@pytest.mark.parametrize("name", ["gaussian", "maternnorm"])
def test_many_blocks_come_within_one_per_cent(spark, name):
    spec = KernelSpec(name)
    x = np.concatenate([RNG.normal(size=(1500, 4)), RNG.normal(size=(500, 4)) * 0.2 + 2])
    exact = mmd(x[selection.greedy_discrepancy(x, 20, spec)], x, spec)
    core = selection.CoreSet(frame(spark, x), spec, 400, 50)
    assert core.size <= 400
    rows = core.rows.collect()
    assert abs(sum(r.w for r in rows) - 2000) < 1e-6
    core.drop()
    got = selection.greedy_picks(frame(spark, x), 20, spec, 400, 50).orderBy("rank").collect()
    assert len({r.id for r in got}) == 20
    y = np.array([r.x for r in got])
    assert np.array_equal(y, x[[r.id for r in got]])
    # of the self energy of twenty points, most of which no choice can lower
    assert mmd(y, x, spec) - exact <= 0.01 * (mmd(y, x, spec) + 2 * kernels.block(spec, y, x).mean())


def test_more_picks_than_a_core_set(spark):
    x = RNG.normal(size=(4000, 2))
    got = selection.greedy_picks(frame(spark, x), 1500, SPEC, block=500).collect()
    assert len(got) == len({r.id for r in got}) == 1500 and len({r.rank for r in got}) == 1500
    y = np.array([r.x for r in got])
    assert mmd(y, x) < 0.2 * mmd(x[:1500], x)


def test_select_keeps_the_columns_and_takes_all_of_a_small_table(spark):
    df = spark.createDataFrame([("a", [0.0], 5), ("b", [1.0], 6)], "id string, x array<double>, rank_of int")
    got = points.greedy_select(df, 9, SPEC).collect()
    assert {(r.id, r.rank_of) for r in got} == {("a", 5), ("b", 6)} and {r.rank for r in got} == {0, 1}
    assert points.greedy_select(df.limit(0), 3, SPEC).count() == 0


def test_match_lowers_the_discrepancy_to_all_rows(spark):
    x = RNG.normal(size=(900, 2))
    df = frame(spark, x)
    start = selection.picked(df, 6, SPEC, 200)
    y = points.match(df, 6, SPEC, 4, 200)
    assert y.shape == (6, 2) and mmd(y, x) < mmd(start, x)
    assert np.allclose(points.match(df.repartition(2), 6, SPEC, 4, 200), y, atol=1e-9)
    assert sorted(map(tuple, points.match(df.where("id < 3"), 5, SPEC))) == sorted(map(tuple, x[:3]))
    labels = {r.id: r.label for r in points.sharp_clusters(df, 4, SPEC, 2).labels(df).collect()}
    c = points.match(df, 4, SPEC, 2)
    assert [labels[k] for k in range(900)] == kernels.distance_block(x, c, None, SPEC).argmin(1).tolist()


def test_tables_beyond_a_block_get_the_exact_choice(spark):
    x = RNG.normal(size=(selection.BLOCK + 700, 3)) * 0.7
    x[1500] = x[40]  # equal points: the least id first
    df = frame(spark, x)
    want = selection.greedy_discrepancy(x, 9, SPEC)
    got = points.greedy_select(df, 9, SPEC).orderBy("rank").collect()
    assert [r.id for r in got] == want.tolist() and [r.rank for r in got] == list(range(9))
    assert np.array_equal(selection.picked(df, 9, SPEC), x[want])
    labels = {r.id: r.label for r in points.greedy_clusters(df, 9, SPEC).labels(df).collect()}
    assert [labels[k] for k in range(len(x))] == kernels.distance_block(x, x[want], None, SPEC).argmin(1).tolist()
