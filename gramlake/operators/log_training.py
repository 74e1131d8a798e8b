"""Agents trained on every row of a decision log.

The kernels are centred on at most n visited rows, chosen by a hash that spans the log;
every row counts in the least-squares sums, so each step is one aggregation of M x M
cells, whatever the log's length. M x M is all that the driver sees.

An empty log leaves the agent as it is. Rows repeated in the log count as often as they
occur; equal centres are held apart by the ridge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, kernels
from . import gram, linalg, model
from .agents import PIECE, Actions, Agent, Games, with_actions

#: Visited rows that become centres (a documented bound); the sums run over all rows.
CENTRE_ROWS = 300
#: Step lengths that one pass tries between two Q functions.
STEPS = np.linspace(0.0, 1.0, 33)
HOWS = ("q", "q_expected", "q_hjb", "actor_critic", "policy_gradient", "actor_critic_expected", "actor_critic_hjb")

_COLUMNS = ["state", "action", "next_state", "reward", "done"]


def games_of(batch: pa.RecordBatch) -> Games:
    """The rows of an Arrow batch of a log as arrays."""
    state, action, nxt, reward, done = (batch.column(k) for k in range(5))
    flat = lambda c, kind: c.to_numpy(zero_copy_only=False).astype(kind)
    return Games(gram.rows_of(state), flat(action, int), gram.rows_of(nxt), flat(reward, float), flat(done, bool))


def centre_rows(log: DataFrame, n: int = CENTRE_ROWS) -> Games:
    """n rows by a hash of game and time (all of a shorter log)."""
    order = [F.xxhash64(F.lit(42), "game", "t"), F.col("game"), F.col("t"), *map(F.col, _COLUMNS)]
    return Games.collect(log.orderBy(*order).limit(n), n)


def _pairs(g: Games, n_actions: int) -> np.ndarray:
    return np.concatenate([g.state, np.eye(n_actions)[g.action]], 1)


def _solved(log: DataFrame, system: Callable[[Games], tuple[np.ndarray, np.ndarray]], width: int, outputs: int, reg: float, inner: np.ndarray | None = None) -> np.ndarray:
    """theta of the least squares of A theta - b over the log, with a ridge that grows with
    the rows, or with a penalty theta' inner theta."""
    a, b, n = linalg.normal_equations(log, lambda t: (*system(games_of(t)), None), _COLUMNS, width, outputs, piece=PIECE)
    scale = max(1.0, n / width)
    return linalg.solve_spd(a + reg * inner, b, 1e-9 * scale) if inner is not None else linalg.solve_spd(a, b, reg * scale)


def _means(log: DataFrame, value: Callable[[Games], np.ndarray], outputs: int) -> np.ndarray:
    """Mean over the log of each column of value."""
    _, total, n = linalg.normal_equations(log, lambda t: (lambda v: (np.ones((len(v), 1)), v, None))(value(games_of(t))), _COLUMNS, 1, outputs, piece=PIECE)
    return total[0] / max(n, 1)


def _largest(log: DataFrame, value: Callable[[Games], np.ndarray]) -> float:
    """Largest absolute value over the log, 0 if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([float(np.abs(value(games_of(batch.slice(s, PIECE)))).max())])], names=["v"])

    return log.select(*_COLUMNS).mapInArrow(run, "v double").agg(F.max("v")).head()[0] or 0.0


def dynamics(log: DataFrame, c: Games, agent: Agent) -> Callable[[Games], Games]:
    """Games -> games whose next states are those expected: a regression of s' - s on
    (s, a) over the log, without its mean error."""
    x, spec, count = _pairs(c, agent.n_actions), agent.spec, agent.n_actions
    d = c.state.shape[1]
    fitted = lambda g: kernels.block(spec, _pairs(g, count), x)
    theta = _solved(log, lambda g: (fitted(g), g.next_state - g.state), len(x), d, max(spec.reg, 1e-2), kernels.block(spec, x, x))
    bias = _means(log, lambda g: g.next_state - g.state - fitted(g) @ theta, d)
    return lambda g: replace(g, next_state=g.state + fitted(g) @ theta + bias)


def _same(g: Games) -> Games:
    return g


def moved(log: DataFrame, move: Callable[[Games], Games]) -> DataFrame:
    """The log with the next states of move, so that they are found once and not a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, PIECE):
                part = batch.slice(s, PIECE)
                yield pa.RecordBatch.from_arrays([gram._lists(move(games_of(part)).next_state) if c == "next_state" else part.column(k) for k, c in enumerate(_COLUMNS)], names=_COLUMNS)

    rows = log.select(*_COLUMNS)
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


class Transition:
    """Stochastic law of the next state given (expected next state, action): weights on the
    centres' next states. Between rows and these states stands the kernel-smoothed joint
    law of the centres; its columns are scaled to equal sums over the whole log (one
    aggregation), then each row to one, so that no state attracts all rows."""

    def __init__(self, log: DataFrame, c: Games, agent: Agent, move: Callable[[Games], Games], of_log: Callable[[Games], Games] | None = None):
        """of_log: what is still to be done to the log's rows (move, if not given)."""
        self.spec, self.n_actions, self.move, self.states = agent.spec, agent.n_actions, of_log or move, c.next_state
        self.x = _pairs(replace(c, state=move(c).next_state), agent.n_actions)
        joint = kernels.block(self.spec, c.next_state, c.next_state)
        near = _means(log, self._near, len(c))
        self.joint = joint / np.maximum(near @ joint, 1e-300)

    def _near(self, g: Games) -> np.ndarray:
        at = _pairs(replace(g, state=self.move(g).next_state), self.n_actions)
        return kernels.block(self.spec, at, self.x)

    def mean(self, values: np.ndarray) -> Callable[[Games], np.ndarray]:
        """Games -> mean under the law of values, a row for each of its states."""
        both = self.joint @ np.concatenate([values, np.ones((len(values), 1))], 1)

        def of(g: Games) -> np.ndarray:
            k = self._near(g) @ both
            return k[:, :-1] / np.maximum(k[:, -1:], 1e-300)

        return of

    def __call__(self, g: Games) -> np.ndarray:
        """len(g) x M weights, each row summing to one."""
        return self.mean(np.eye(len(self.states)))(g)


def evaluated_hjb(log: DataFrame, c: Games, agent: Agent, law: Transition) -> Agent:
    """Q of the agent's policy with the future averaged over the law of the next state:
    (K - gamma P sum_a pi K') theta = r, K' at every action of the law's states."""
    y = _pairs(c, agent.n_actions)
    nxt = kernels.block(agent.spec, with_actions(law.states, agent.n_actions), y).reshape(len(law.states), agent.n_actions, -1)
    future = law.mean(np.einsum("na,nam->nm", agent.policy(law.states), nxt))

    def system(g):
        return kernels.block(agent.spec, _pairs(g, agent.n_actions), y) - agent.gamma * future(g) * ~g.done[:, None], g.reward[:, None]

    return replace(agent, y=y, theta=_solved(log, system, len(y), 1, agent.spec.reg))


def optimal_hjb(log: DataFrame, c: Games, agent: Agent, law: Transition, rounds: int = 5, tol: float = 1e-6) -> Agent:
    """Optimal Q of Q(s, a) = r + gamma E max_b Q(s', b), s' by the law: policy iteration as
    in optimal(), the best action taken at each of the law's states."""
    y = _pairs(c, agent.n_actions)
    at = lambda g: kernels.block(agent.spec, _pairs(g, agent.n_actions), y)
    nxt = kernels.block(agent.spec, with_actions(law.states, agent.n_actions), y).reshape(len(law.states), agent.n_actions, -1)
    theta = _solved(log, lambda g: (at(g), g.reward[:, None]), len(y), 1, agent.spec.reg)
    for _ in range(rounds):
        best = law.mean(nxt[np.arange(len(nxt)), (nxt @ theta)[..., 0].argmax(1)])
        step = _solved(log, lambda g, best=best: (at(g) - agent.gamma * best(g) * ~g.done[:, None], g.reward[:, None]), len(y), 1, agent.spec.reg) - theta
        tops = law.mean(((nxt @ theta) + (nxt @ step) * STEPS).max(1))  # best value of each state at each step length

        def errors(g, theta=theta, step=step, tops=tops):
            k = at(g)
            return (k @ theta + (k @ step) * STEPS - g.reward[:, None] - agent.gamma * tops(g) * ~g.done[:, None]) ** 2

        found = _means(log, errors, len(STEPS))
        best_step = int(found.argmin())
        if found[best_step] > found[0] - tol:
            break
        theta = theta + STEPS[best_step] * step
    return replace(agent, y=y, theta=theta)


def policy_derivative(log: DataFrame, c: Games, agent: Agent) -> np.ndarray:
    """M x A: derivative of the mean over the log of V(s) = sum_a pi(a|s) Q(s, a), Q the
    value of the policy, in the logits of the policy at its states (the centres', if it has
    none yet). Three aggregations: Q's least squares, the mean of dV/dtheta, and, with the
    adjoint of the solve, the slopes (Agent.slopes)."""
    y, agent = _pairs(c, agent.n_actions), agent.with_logits(c.state)
    a, b, n = linalg.normal_equations(log, lambda t: (lambda g: (agent.rows(g, y)[0], g.reward[:, None], None))(games_of(t)), _COLUMNS, len(y), 1, piece=PIECE)
    h = a + agent.spec.reg * max(1.0, n / len(y)) * np.eye(len(y))
    mean = _means(log, lambda g: agent.value_rows(g, y), len(y))
    theta, adjoint = np.linalg.solve(h, b), np.linalg.solve(h, mean[:, None])
    size = len(agent.states) * agent.n_actions
    _, out, _ = linalg.normal_equations(log, lambda t: (np.ones((1, 1)), agent.slopes(games_of(t), y, theta, adjoint, n).reshape(1, -1), None), _COLUMNS, 1, size, piece=PIECE)
    return out.reshape(len(agent.states), agent.n_actions)


def _blocks(agent: Agent, g: Games, y: np.ndarray) -> tuple[np.ndarray, Actions]:
    """K at the visited pairs, and at every action of the next states."""
    return kernels.block(agent.spec, _pairs(g, agent.n_actions), y), Actions(agent.spec, g.next_state, y, agent.n_actions)


def evaluated(log: DataFrame, c: Games, agent: Agent, move: Callable[[Games], Games] = _same) -> Agent:
    """Q of the agent's policy: (K - gamma sum_a pi K') theta = r over the log."""
    y = _pairs(c, agent.n_actions)

    def system(g):
        g = move(g)
        k, nxt = _blocks(agent, g, y)
        mix = nxt.mean(agent.policy(g.next_state)) * ~g.done[:, None]
        return k - agent.gamma * mix, g.reward[:, None]

    return replace(agent, y=y, theta=_solved(log, system, len(y), 1, agent.spec.reg))


def optimal(log: DataFrame, c: Games, agent: Agent, move: Callable[[Games], Games] = _same, rounds: int = 5, tol: float = 1e-6) -> Agent:
    """Optimal Q by policy iteration: a round is one aggregation for the next Q and one
    for the mean squared Bellman error at 33 step lengths towards it."""
    y = _pairs(c, agent.n_actions)
    theta = _solved(log, lambda g: (kernels.block(agent.spec, _pairs(g, agent.n_actions), y), g.reward[:, None]), len(y), 1, agent.spec.reg)
    for _ in range(rounds):

        def system(g, theta=theta):
            g = move(g)
            k, nxt = _blocks(agent, g, y)
            best = nxt.at(nxt.values(theta)[..., 0].argmax(1))
            return k - agent.gamma * best * ~g.done[:, None], g.reward[:, None]

        step = _solved(log, system, len(y), 1, agent.spec.reg) - theta

        def errors(g, theta=theta, step=step):
            g = move(g)
            k, nxt = _blocks(agent, g, y)
            q = k @ theta + (k @ step) * STEPS
            now, more = np.moveaxis(nxt.values(np.concatenate([theta, step], 1)), 2, 0)
            future = (now[..., None] + more[..., None] * STEPS).max(1) * ~g.done[:, None]
            return (q - g.reward[:, None] - agent.gamma * future) ** 2

        found = _means(log, errors, len(STEPS))
        at = int(found.argmin())
        if found[at] > found[0] - tol:
            break
        theta = theta + STEPS[at] * step
    return replace(agent, y=y, theta=theta)


def improved(log: DataFrame, c: Games, agent: Agent, advantages: Callable[[Games], np.ndarray]) -> Agent:
    """Replicator step on advantages over the log's largest one, then the regression of
    the new log-probabilities on all visited states."""
    centred = lambda g: (lambda a: a - a.mean(1, keepdims=True))(advantages(g))
    size = _largest(log, centred) or 1.0

    def system(g):
        p = model.softmax(np.log(np.maximum(agent.policy(g.state), 1e-9)) + centred(g) / size)
        return kernels.block(agent.spec, g.state, c.state), np.log(np.maximum(p, 1e-9))

    inner = kernels.block(agent.spec, c.state, c.state)
    return replace(agent, states=c.state, log_policy=_solved(log, system, len(c), agent.n_actions, agent.spec.reg, inner))


def fit_all(agent: Agent, log: DataFrame, how: str = "q", n: int = CENTRE_ROWS) -> Agent:
    """One of HOWS on every row of a log of any size. The log is kept by the executors
    while it is read again and again; a lost one recomputes its part."""
    if how not in HOWS:
        raise ValueError(f"{how} is none of {', '.join(HOWS)}")
    log = log.select("game", "t", *_COLUMNS).persist()
    try:
        c = centre_rows(log, n)
        if not len(c):
            return agent
        if how == "policy_gradient":
            return agent.with_logits(c.state).stepped(policy_derivative(log, c, agent))
        law = None
        if how not in ("q", "actor_critic"):
            move = dynamics(log, c, agent)
            given, log = log, moved(log, move).persist()
            if how.endswith("hjb"):
                law = Transition(log, c, agent, move, _same)
            else:
                log.count()
            given.unpersist()
        if how.startswith("q"):
            return optimal_hjb(log, c, agent, law) if law else optimal(log, c, agent)
        critic = evaluated_hjb(log, c, agent, law) if law else evaluated(log, c, agent)
        return improved(log, c, critic, lambda g: critic.q_values(g.state))
    finally:
        log.unpersist()


def state_values(agent: Agent, log: DataFrame, states: DataFrame, n: int = CENTRE_ROWS) -> DataFrame:
    """(id, v) of states (id, x): V with (K - gamma K') theta = pi r over the whole log;
    an empty log gives 0."""
    log = log.select("game", "t", *_COLUMNS).persist()
    try:
        c = centre_rows(log, n)
        if not len(c):
            return states.select("id", F.lit(0.0).alias("v"))

        def system(g):
            k = kernels.block(agent.spec, g.state, c.state)
            nxt = kernels.block(agent.spec, g.next_state, c.state) * ~g.done[:, None]
            r = agent.policy(g.state)[np.arange(len(g)), g.action] * g.reward
            return k - agent.gamma * nxt, r[:, None]

        theta = _solved(log, system, len(c), 1, agent.spec.reg)
    finally:
        log.unpersist()
    at = gram.Centres(np.arange(len(c)), c.state)
    return gram.knm(states, at, agent.spec, theta).select("id", F.get("k", F.lit(0)).alias("v"))


def policy_actions(agent: Agent, states: DataFrame) -> DataFrame:
    """(id, action) of states (id, x): the likeliest action, the first on ties."""
    kind = states.schema["id"].dataType.simpleString()
    width = agent.n_actions if agent.states is None else len(agent.states)
    p = gram.by_block(states, lambda ids, m: {"id": ids[0], "p": gram._lists(agent.policy(m))}, f"id {kind}, p array<double>", max(width, gram.CELLS // PIECE))
    return p.select("id", arrays.argmax(F.col("p")).alias("action"))
