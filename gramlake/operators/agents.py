"""Value functions and agents for decision logs.

A log is a frame (game, t, state array, action, next_state array, reward, done), t
descending in time order as given by the caller. States are bounded per fit (the
kernel systems are M x M); everything per row, such as Bellman errors, advantages and
greedy actions, stays in column expressions or narrow block passes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, kernels
from ..plans.spec import KernelSpec
from . import gram, linalg, model, optimize, order
from .conditional import TransportConditional

GAMMA = 0.99


def formatted(log: DataFrame, n_actions: int, gamma: float = GAMMA, keep: int | None = None) -> DataFrame:
    """Casts, one-hot actions (numeric order), returns, and the last rows of each game."""
    rows = log.select(F.col("game"), F.col("t"), F.col("state"), F.col("action").cast("int"), arrays.one_hot(F.col("action"), n_actions).alias("action_hot"), F.col("next_state"), F.col("reward").cast("double"), F.col("done").cast("boolean"))
    rows = order.discounted_returns(rows, "game", "reward", [F.desc("t")], gamma, "returns")
    return order.keep_last(rows, [F.desc("t")], keep, "game") if keep else rows


def all_state_actions(states: DataFrame, n_actions: int) -> DataFrame:
    """Every state with every one-hot action, state-major."""
    acts = F.explode(F.sequence(F.lit(0), F.lit(n_actions - 1)))
    return states.select("*", acts.alias("action")).withColumn("action_hot", arrays.one_hot(F.col("action"), n_actions))


def bellman_error(q: Column, reward: Column, next_q: Column, done: Column, gamma: float = GAMMA, policy: Column | None = None) -> Column:
    """Q(s,a) - r - gamma max (or policy mean) of Q(s', .); a terminal row has no future."""
    future = F.array_max(next_q) if policy is None else arrays.total(F.zip_with(next_q, policy, lambda a, b: a * b))
    return q - reward - gamma * F.when(done, F.lit(0.0)).otherwise(future)


def optimal_action(q: Column, reward: Column, next_q: Column, gamma: float = GAMMA) -> Column:
    """Place of the largest gamma Q(s', .) + r - Q(s, a)."""
    return arrays.argmax(F.transform(next_q, lambda v: v * gamma + reward - q))


def advantages(q_next: Column, reward: Column, q: Column, done: Column, gamma: float = GAMMA) -> Column:
    """r + gamma Q(s', .) - Q(s, a), centred; zero at terminal rows."""
    raw = F.transform(q_next, lambda v: reward + gamma * v - q)
    return arrays.let(raw, lambda x: arrays.let(arrays.total(x) / F.size(x), lambda mean: F.transform(x, lambda v: F.when(done, F.lit(0.0)).otherwise(v - mean))))


def greedy_policy(q: Column, n: int) -> Column:
    """One-hot of the best action, the first on ties."""
    return arrays.let(arrays.argmax(q), lambda k: arrays.one_hot(k, n))


@dataclass(frozen=True)
class Games:
    """A bounded batch of rows as arrays."""

    state: np.ndarray
    action: np.ndarray
    next_state: np.ndarray
    reward: np.ndarray
    done: np.ndarray

    @classmethod
    def collect(cls, log: DataFrame, limit: int = linalg.DRIVER_ROWS) -> "Games":
        n = log.count()
        if n > limit:
            raise ValueError(f"{n} rows; at most {limit} make one kernel system: trim the log or train per game")
        t = log.orderBy("game", F.desc("t")).select("state", "action", "next_state", "reward", "done").toArrow()
        cols = [t.column(k).to_pylist() for k in range(5)]
        return cls(np.array(cols[0], float), np.array(cols[1], int), np.array(cols[2], float), np.array(cols[3], float), np.array(cols[4], bool))

    def __len__(self) -> int:
        return len(self.reward)


def _hot(a: np.ndarray, n: int) -> np.ndarray:
    return np.eye(n)[a]


def with_actions(states: np.ndarray, n: int) -> np.ndarray:
    """(N n) x (D + n): every state with every one-hot action."""
    return np.concatenate([np.repeat(states, n, 0), np.tile(np.eye(n), (len(states), 1))], 1)


#: Rows whose kernels are held at once, so that a block stays near a core's cache.
PIECE = 1024


class Actions:
    """K((s, a), y) of some states s and every action a. A gaussian is the product of its
    values on states and on actions, so that one block of states serves all actions."""

    def __init__(self, spec: KernelSpec, states: np.ndarray, y: np.ndarray, n: int):
        d, self.k, self.n = states.shape[1], None, n
        if spec.name == "gaussian" and not spec.factors:
            self.of_states, self.of_actions = kernels.block(spec, states, y[:, :d]), kernels.block(spec, np.eye(n), y[:, d:])
        else:
            self.k = kernels.block(spec, with_actions(states, n), y).reshape(len(states), n, -1)

    def values(self, theta: np.ndarray) -> np.ndarray:
        """States x actions x columns of theta."""
        if self.k is not None:
            return self.k @ theta
        scaled = self.of_actions.T[:, :, None] * theta[:, None]
        return (self.of_states @ scaled.reshape(len(theta), -1)).reshape(-1, self.n, theta.shape[1])

    def at(self, actions: np.ndarray) -> np.ndarray:
        """Rows of one action each."""
        return self.of_states * self.of_actions[actions] if self.k is None else self.k[np.arange(len(self.k)), actions]

    def mean(self, weights: np.ndarray) -> np.ndarray:
        """Rows weighted over the actions."""
        return self.of_states * (weights @ self.of_actions) if self.k is None else np.einsum("na,nam->nm", weights, self.k)


@dataclass(frozen=True)
class Agent:
    """Kernel agent: a Q function theta on visited (state, action) pairs, and a policy
    as a regression of log-probabilities on visited states."""

    n_actions: int
    gamma: float = GAMMA
    spec: KernelSpec = KernelSpec("gaussian", reg=1e-6)
    y: np.ndarray | None = None
    theta: np.ndarray | None = None
    states: np.ndarray | None = None
    log_policy: np.ndarray | None = None
    epsilon: float = 0.1

    def q_values(self, states: np.ndarray) -> np.ndarray:
        if self.y is None:
            return np.zeros((len(states), self.n_actions))
        return Actions(self.spec, states, self.y, self.n_actions).values(self.theta)[..., 0]

    def policy(self, states: np.ndarray) -> np.ndarray:
        if self.log_policy is None:
            return np.full((len(states), self.n_actions), 1 / self.n_actions)
        return model.softmax(kernels.block(self.spec, states, self.states) @ self.log_policy)

    # per-row application over a log of any size

    def with_values(self, log: DataFrame) -> DataFrame:
        """The log with q (all actions) and next_q, in one narrow pass."""
        rows = log.withColumn("id", F.monotonically_increasing_id()).withColumn("x", F.concat("state", "next_state"))
        fields = [c for c in log.columns]
        kind = ", ".join(f"`{c}` {log.schema[c].dataType.simpleString()}" for c in fields)

        def block(ids, m):
            d = m.shape[1] // 2
            cols = dict(zip(fields, ids[1:]))
            return {**cols, "q": gram._lists(self.q_values(m[:, :d])), "next_q": gram._lists(self.q_values(m[:, d:]))}

        return gram.by_block(rows, block, f"{kind}, q array<double>, next_q array<double>", gram.CELLS // PIECE, more=tuple(fields))

    def act(self, states: DataFrame, seed: int = 42, greedy: bool = False) -> DataFrame:
        """(id, action): argmax of Q, or with chance epsilon a seeded random action."""
        from .sampling import hash_uniform

        kind = states.schema["id"].dataType.simpleString()
        q = gram.by_block(states, lambda ids, m: {"id": ids[0], "q": gram._lists(self.q_values(m))}, f"id {kind}, q array<double>", gram.CELLS // PIECE)
        best = arrays.argmax(F.col("q"))
        random = F.floor(hash_uniform(seed, "id") * self.n_actions).cast("int")
        return q.select("id", (best if greedy else F.when(hash_uniform(seed + 1, "id") < self.epsilon, random).otherwise(best)).alias("action"))

    # policy evaluation and improvement on a bounded batch

    def evaluate(self, g: Games, policy: np.ndarray | None = None) -> "Agent":
        """Q of a policy: theta with (K - gamma sum_a pi K') theta = r, terminal rows
        without K'."""
        y = np.concatenate([g.state, _hot(g.action, self.n_actions)], 1)
        k = kernels.block(self.spec, y, y)
        pi = self.policy(g.next_state) if policy is None else policy
        nxt = kernels.block(self.spec, with_actions(g.next_state, self.n_actions), y).reshape(len(g), self.n_actions, -1)
        mix = np.einsum("na,nam->nm", pi, nxt) * ~g.done[:, None]
        return replace(self, y=y, theta=linalg.lstsq(k - self.gamma * mix, g.reward[:, None], self.spec.reg))

    def state_values(self, g: Games, policy: np.ndarray | None = None) -> np.ndarray:
        """V at the batch's states: (K - gamma K') theta = sum_a pi r, per visited row."""
        k = kernels.block(self.spec, g.state, g.state)
        nxt = kernels.block(self.spec, g.next_state, g.state) * ~g.done[:, None]
        pi = self.policy(g.state) if policy is None else policy
        r = pi[np.arange(len(g)), g.action] * g.reward
        return (k @ linalg.lstsq(k - self.gamma * nxt, r[:, None], self.spec.reg))[:, 0]

    def optimal(self, g: Games, rounds: int = 5, tol: float = 1e-6, expected_next: np.ndarray | None = None) -> "Agent":
        """Optimal Q by policy iteration; each step's length is found by a line search on
        the Bellman error. expected_next: next states from a model of the dynamics."""
        g = g if expected_next is None else replace(g, next_state=expected_next)
        y = np.concatenate([g.state, _hot(g.action, self.n_actions)], 1)
        k = kernels.block(self.spec, y, y)
        nxt = kernels.block(self.spec, with_actions(g.next_state, self.n_actions), y).reshape(len(g), self.n_actions, -1)
        live = (~g.done)[:, None]

        def error(theta: np.ndarray) -> float:
            future = (nxt @ theta)[..., 0].max(1) * live[:, 0]
            return float(np.mean(((k @ theta)[:, 0] - g.reward - self.gamma * future) ** 2))

        theta = linalg.lstsq(k, g.reward[:, None], self.spec.reg) if self.y is None or self.y.shape != y.shape else self.theta
        for _ in range(rounds):
            best = (nxt @ theta)[..., 0].argmax(1)
            chosen = nxt[np.arange(len(g)), best] * live
            new = linalg.lstsq(k - self.gamma * chosen, g.reward[:, None], self.spec.reg)
            s = optimize.golden(lambda t: error(theta + t * (new - theta)), 0.0, 1.0, 30)
            if error(theta + s * (new - theta)) > error(theta) - tol:
                break
            theta = theta + s * (new - theta)
        return replace(self, y=y, theta=theta)

    def advantages(self, g: Games) -> np.ndarray:
        """r + gamma Q(s', .) - Q(s, a), centred, zero at terminal rows."""
        q = self.q_values(g.state)[np.arange(len(g)), g.action]
        a = g.reward[:, None] + self.gamma * self.q_values(g.next_state) - q[:, None]
        return (a - a.mean(1, keepdims=True)) * ~g.done[:, None]

    def improve(self, g: Games, advantages: np.ndarray, dt: float | None = None) -> "Agent":
        """Replicator step on normalised advantages, then the policy's regression."""
        a = advantages - advantages.mean(1, keepdims=True)
        size = np.abs(a).max()
        a = a / size * (1.0 if dt is None else dt) if size > 0 else a
        p = np.maximum(model.softmax(np.log(np.maximum(self.policy(g.state), 1e-9)) + a), 1e-9)
        return replace(self, states=g.state, log_policy=model.knm_inv(g.state, g.state, self.spec, np.log(p)))

    # derivative of the policy's value in the policy, which enters directly and through Q

    def with_logits(self, states: np.ndarray) -> "Agent":
        """The agent with a policy on states: uniform, unless it has one already."""
        return self if self.log_policy is not None else replace(self, states=states, log_policy=np.zeros((len(states), self.n_actions)))

    def rows(self, g: Games, y: np.ndarray) -> tuple[np.ndarray, Actions]:
        """Rows K - gamma sum_a pi K' of Q's least squares, and K' at every next action."""
        k = kernels.block(self.spec, np.concatenate([g.state, _hot(g.action, self.n_actions)], 1), y)
        nxt = Actions(self.spec, g.next_state, y, self.n_actions)
        return k - self.gamma * nxt.mean(self.policy(g.next_state)) * ~g.done[:, None], nxt

    def value_rows(self, g: Games, y: np.ndarray) -> np.ndarray:
        """dV/dtheta at each visited state."""
        return Actions(self.spec, g.state, y, self.n_actions).mean(self.policy(g.state))

    def slopes(self, g: Games, y: np.ndarray, theta: np.ndarray, adjoint: np.ndarray, total: int) -> np.ndarray:
        """Share of these rows in the derivative of the mean of V over total rows, in the
        logits of the policy. H theta = A'r gives d theta = H^-1 (dA'(r - A theta) - A'dA theta);
        adjoint is H^-1 of the mean of dV/dtheta, so no derivative of theta is formed."""
        through_softmax = lambda p, q: p * (q - (p * q).sum(1, keepdims=True))
        rows, nxt = self.rows(g, y)
        here = Actions(self.spec, g.state, y, self.n_actions)
        direct = through_softmax(self.policy(g.state), here.values(theta)[..., 0]) / total
        by_q = self.gamma * (nxt.values(adjoint)[..., 0] * (rows @ theta - g.reward[:, None]) + nxt.values(theta)[..., 0] * (rows @ adjoint))
        indirect = through_softmax(self.policy(g.next_state), by_q) * ~g.done[:, None]
        return kernels.block(self.spec, g.state, self.states).T @ direct + kernels.block(self.spec, g.next_state, self.states).T @ indirect

    def stepped(self, slopes: np.ndarray, dt: float = 1.0) -> "Agent":
        """The policy's logits moved along the slopes, scaled to dt at most."""
        size = np.abs(slopes).max()
        return replace(self, log_policy=self.log_policy + slopes / size * dt) if size > 0 else self

    def policy_derivative(self, g: Games) -> np.ndarray:
        """The derivative on a bounded batch (log_training has it for a log of any size)."""
        agent, y = self.with_logits(g.state), np.concatenate([g.state, _hot(g.action, self.n_actions)], 1)
        a = agent.rows(g, y)[0]
        h = a.T @ a + self.spec.reg * np.eye(len(y))
        theta = np.linalg.solve(h, a.T @ g.reward[:, None])
        adjoint = np.linalg.solve(h, agent.value_rows(g, y).mean(0)[:, None])
        return agent.slopes(g, y, theta, adjoint, len(g))

    def train_actor_critic(self, log: DataFrame) -> "Agent":
        """Evaluate the policy, then improve it at the visited states: the advantage of an
        action there is its Q against the mean of all."""
        g = Games.collect(log)
        critic = self.evaluate(g)
        return critic.improve(g, critic.q_values(g.state))

    def train_policy_gradient(self, log: DataFrame) -> "Agent":
        g = Games.collect(log)
        return self.with_logits(g.state).stepped(self.policy_derivative(g))

    def train_q(self, log: DataFrame, expected: bool = False) -> "Agent":
        """Optimal Q on the log; expected: next states from the fitted dynamics first."""
        g = Games.collect(log)
        return self.optimal(g, expected_next=expected_next_states(g, self.n_actions, self.spec) if expected else None)

    def train_actor_critic_expected(self, log: DataFrame) -> "Agent":
        g = Games.collect(log)
        g = replace(g, next_state=expected_next_states(g, self.n_actions, self.spec))
        critic = self.evaluate(g)
        return critic.improve(g, critic.q_values(g.state))


def expected_next_states(g: Games, n_actions: int, spec: KernelSpec) -> np.ndarray:
    """Regression of s' - s on (s, a), without its mean error."""
    x = np.concatenate([g.state, _hot(g.action, n_actions)], 1)
    step = g.next_state - g.state
    ridge = spec.with_reg(max(spec.reg, 1e-2))
    fitted = kernels.block(spec, x, x) @ model.knm_inv(x, x, ridge, step)
    return g.state + fitted + (step - fitted).mean(0)


def conditioned_dynamics(spark, g: Games, n_actions: int, spec: KernelSpec) -> TransportConditional:
    """Law of the next state given (expected state, action)."""
    x = np.concatenate([expected_next_states(g, n_actions, spec), _hot(g.action, n_actions)], 1)
    d = g.next_state.shape[1]
    rows = [(k, [float(v) for v in a], *map(float, b)) for k, (a, b) in enumerate(zip(x, g.next_state))]
    return TransportConditional.fit(spark.createDataFrame(rows, "id long, x array<double>, " + ", ".join(f"n{j} double" for j in range(d))), [f"n{j}" for j in range(d)], spec)


@dataclass(frozen=True)
class RoutedModels:
    """Sub-models by batch of games; a point goes to the one whose nearest training point
    is nearest. With one model there is no routing."""

    parts: tuple[model.KernelModel, ...] = ()
    max_parts: int = 1 << 30

    def add(self, part: model.KernelModel) -> "RoutedModels":
        k = len(self.parts) % self.max_parts if len(self.parts) >= self.max_parts else len(self.parts)
        return replace(self, parts=(*self.parts[:k], part, *self.parts[k + 1 :]))

    def route(self, z: np.ndarray) -> np.ndarray:
        return np.stack([kernels.sq_dist(z, p.y.x).min(1) for p in self.parts], 1).argmin(1)

    def values(self, z: np.ndarray) -> np.ndarray:
        at = self.route(z)
        out = np.zeros((len(z), self.parts[0].theta.shape[1]))
        for k in np.unique(at):
            out[at == k] = self.parts[k].values(z[at == k])
        return out

    def predict(self, z: DataFrame, softmax: bool = False) -> DataFrame:
        kind = z.schema["id"].dataType.simpleString()
        finish = model.softmax if softmax else (lambda v: v)
        return gram.by_block(z, lambda ids, m: {"id": ids[0], "f": gram._lists(finish(self.values(m)))}, f"id {kind}, f array<double>", max(len(p) for p in self.parts))


@dataclass(frozen=True)
class Controller:
    """Parameters of a user's controller, tuned on (parameters, mean reward) of games."""

    spec: KernelSpec = KernelSpec("gaussian", reg=1e-6)
    tried: tuple[tuple[float, ...], ...] = ()
    rewards: tuple[float, ...] = ()

    def record(self, parameters, log: DataFrame) -> "Controller":
        r = log.agg(F.avg("reward")).head()[0]
        return replace(self, tried=(*self.tried, tuple(map(float, parameters))), rewards=(*self.rewards, float(r)))

    def propose(self, draw, explore: float = 0.1) -> np.ndarray:
        """Parameters with the best regressed reward plus a bonus for distance to those
        tried."""
        x, r = np.array(self.tried), np.array(self.rewards)[:, None]
        theta = model.knm_inv(x, x, self.spec, r)

        def f(z):
            return (kernels.block(self.spec, z, x) @ theta)[:, 0] + explore * np.sqrt(kernels.sq_dist(z, x).min(1))

        return optimize.continuous(f, draw)[0]


