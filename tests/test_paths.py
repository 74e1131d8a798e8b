"""Shortest augmenting paths on short lists against augmenting paths on whole matrices."""

import numpy as np
import pytest

from gramlake.operators import auction, paths, transport

RNG = np.random.default_rng(8)


def lists(cost):
    def near(rows, widths, v):
        value = cost[rows] - v
        order = [np.argsort(line, kind="stable")[:w] for line, w in zip(value, widths)]
        bounds = [paths.FAR if w >= len(v) else line[o[-1]] for line, w, o in zip(value, widths, order)]
        costs = [cost[r][o] for r, o in zip(rows, order)]
        return np.array([len(o) for o in order]), np.concatenate(order).astype(np.int32), np.concatenate(costs).astype(np.int64), np.array(bounds, np.int64)

    return near


@pytest.mark.parametrize("width", [1, 3, 64])
def test_short_lists_leave_nothing_out(width):
    for high in (1, 2, 50, 10**9):
        for n in (1, 2, 17, 45):
            for cost in (RNG.integers(-high, high, (n, n)), np.repeat(np.repeat(RNG.integers(0, high + 1, (n, n)), 3, 0), 3, 1)):
                kinds = np.unique(cost, axis=0, return_inverse=True)[1].ravel()
                start = RNG.integers(-high, high + 1, len(cost))
                place, u, v = paths.solve(start, lists(cost), width, kinds)
                at = np.arange(len(cost))
                assert sorted(place.tolist()) == at.tolist() and (cost - u[:, None] - v).min() >= 0
                assert cost[at, place].sum() == u.sum() + v.sum() == cost[at, transport.assign(cost)].sum()


def test_whole_costs_of_frames_take_few_jobs(spark, monkeypatch):
    """A job for every round of bids never ended on large tables."""
    monkeypatch.setattr(auction, "MOST_ROWS", 20)
    x = RNG.normal(size=(150, 8))
    x[:60], x[60:80] = x[0], x[60]  # copies of one point
    cost = lambda a, b: np.rint(1000 * ((a[:, None] - b[None, :, ::-1]) ** 2).sum(2))
    frame = spark.createDataFrame([(3 * k, r.tolist()) for k, r in enumerate(x)], "id long, x array<double>")
    spark.sparkContext.setJobGroup("whole-costs", "matching")
    try:
        got = auction.match(frame, frame, cost, whole=True, size=64).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    c = cost(x, x)
    assert len({r.x_id for r in got}) == len({r.y_id for r in got}) == 150
    assert sum(r.cost for r in got) == c[np.arange(150), transport.assign(c)].sum()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole-costs")) < 300


def test_other_costs_of_frames_are_met_by_auction(spark):
    x = RNG.normal(size=(40, 3))
    frame = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, x array<double>")
    got = auction.match(frame, frame, lambda a, b: ((a[:, None] - b[None, :, ::-1]) ** 2).sum(2)).collect()
    c = ((x[:, None] - x[None, :, ::-1]) ** 2).sum(2)
    assert len({r.y_id for r in got}) == 40
    assert sum(r.cost for r in got) <= c[np.arange(40), transport.assign(c)].sum() + 1e-6 * c.max()
