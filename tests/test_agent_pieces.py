"""Agents on long logs: blocks of bounded rows, and one block of states for all actions."""

import numpy as np
import pytest

from gramlake.functions import kernels
from gramlake.operators import agents, log_training
from gramlake.plans.spec import KernelSpec

RNG = np.random.default_rng(8)


@pytest.mark.parametrize("spec", [KernelSpec("gaussian"), KernelSpec("maternnorm")])
def test_all_actions_from_one_block(spec):
    states, y = RNG.normal(size=(40, 2)), agents.with_actions(RNG.normal(size=(7, 2)), 3)
    whole = kernels.block(spec, agents.with_actions(states, 3), y).reshape(40, 3, -1)
    theta, at, p = RNG.normal(size=(21, 2)), RNG.integers(0, 3, 40), RNG.random((40, 3))
    found = agents.Actions(spec, states, y, 3)
    assert np.allclose(found.values(theta), whole @ theta) and np.allclose(found.at(at), whole[np.arange(40), at])
    assert np.allclose(found.mean(p), np.einsum("na,nam->nm", p, whole))


@pytest.mark.parametrize("how", log_training.HOWS)
def test_blocks_of_a_long_log_are_bounded(spark, how):
    most, n = 3 * agents.PIECE, 7000

    def k(a, b):
        assert len(a) <= most, f"a block of {len(a)} rows"
        return np.exp(-kernels.sq_dist(a, b))

    rows = [(i % 5, float(i), [float(v) for v in RNG.random(2)], i % 3, [float(v) for v in RNG.random(2)], float(RNG.random()), i % 50 == 49) for i in range(n)]
    log = spark.createDataFrame(rows, "game long, t double, state array<double>, action int, next_state array<double>, reward double, done boolean").coalesce(1)
    agent = log_training.fit_all(agents.Agent(3, spec=KernelSpec("user", reg=1e-3, params={"k": k})), log, how, 12)
    states = log.selectExpr("cast(t as long) as id", "state as x")
    acts = agent.act(states, greedy=True) if how.startswith("q") else log_training.policy_actions(agent, states)
    assert acts.where("action between 0 and 2").count() == n
    plain = log_training.fit_all(agents.Agent(3, spec=KernelSpec("gaussian", reg=1e-3)), log, how, 12)
    for name in ("theta", "log_policy"):
        a, b = getattr(agent, name), getattr(plain, name)
        assert (a is None) == (b is None) and (a is None or np.allclose(a, b, atol=1e-6))
