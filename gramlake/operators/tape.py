"""Derivatives of functions of rows by a reverse-mode tape, exact to rounding.

A function is written in numpy (+ - * / **, @ with constants, exp, log, sqrt, sin, cos,
tanh, absolute, maximum, minimum, indexing, sum, mean, stack). Called with a Tape it
records each step with the rule that carries sensitivities back; the rules are written in
the same operations, so a gradient is itself on the tape and can be differentiated again.

Rows do not depend on each other: one backward pass of a column's sum over a block gives
the gradients of all its rows, d of them a Hessian. Over a DataFrame, blocks are the Arrow
batches of the tasks: one narrow pass, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from . import gram

RULES: dict = {}
Function = Callable[["Tape"], "Tape"]


def _reduced(g, shape: tuple[int, ...]):
    """Sum of a sensitivity over the axes along which an operand was repeated."""
    if value(g).shape == shape:
        return g
    while value(g).ndim > len(shape):
        g = total(g, 0)
    for k, n in enumerate(shape):
        if n == 1 and value(g).shape[k] != 1:
            g = total(g, k, True)
    return g


def value(a) -> np.ndarray:
    return a.value if isinstance(a, Tape) else np.asarray(a, float)


class Tape:
    """An array with the steps that made it: (operand, rule) pairs."""

    __slots__ = ("value", "steps")
    __array_priority__ = 100

    def __init__(self, x, steps=()):
        self.value, self.steps = np.asarray(x, float), steps

    shape = property(lambda self: self.value.shape)
    ndim = property(lambda self: self.value.ndim)
    T = property(lambda self: transposed(self))

    def __len__(self) -> int:
        return len(self.value)

    def __array_ufunc__(self, ufunc, method, *inputs, **more):
        rule = RULES.get(ufunc.__name__)
        if method != "__call__" or more or rule is None:
            raise TypeError(f"{ufunc.__name__} has no rule on the tape")
        return rule(*inputs)

    def __array_function__(self, f, types, args, more):
        if f.__name__ in ("sum", "mean"):
            return getattr(args[0], f.__name__)(*args[1:], **more)
        if f.__name__ == "stack":
            return stacked(*args, **more)
        raise TypeError(f"{f.__name__} has no rule on the tape")

    def __getitem__(self, at):
        return taken(self, at)

    def sum(self, axis=None, keepdims=False):
        return total(self, axis, keepdims)

    def mean(self, axis=None, keepdims=False):
        return total(self, axis, keepdims) * (value(total(self, axis, keepdims)).size / self.value.size)

    __neg__ = lambda self: np.negative(self)
    __abs__ = lambda self: np.absolute(self)


def _operators(name: str, ufunc: np.ufunc) -> None:
    setattr(Tape, f"__{name}__", lambda self, other: ufunc(self, other))
    setattr(Tape, f"__r{name}__", lambda self, other: ufunc(other, self))


for _name, _ufunc in (("add", np.add), ("sub", np.subtract), ("mul", np.multiply), ("truediv", np.divide), ("pow", np.power), ("matmul", np.matmul)):
    _operators(_name, _ufunc)


def rule(name: str):
    def keep(make):
        RULES[name] = make
        return make

    return keep


def _step(x: np.ndarray, *pairs) -> Tape:
    """A recorded step: pairs of operand and rule, constants left out."""
    return Tape(x, tuple((a, back) for a, back in pairs if isinstance(a, Tape)))


def _two(x: np.ndarray, a, b, back_a, back_b) -> Tape:
    return _step(x, (a, lambda g: _reduced(back_a(g), value(a).shape)), (b, lambda g: _reduced(back_b(g), value(b).shape)))


rule("add")(lambda a, b: _two(value(a) + value(b), a, b, lambda g: g, lambda g: g))
rule("subtract")(lambda a, b: _two(value(a) - value(b), a, b, lambda g: g, lambda g: -g))
rule("multiply")(lambda a, b: _two(value(a) * value(b), a, b, lambda g: g * b, lambda g: g * a))
rule("divide")(lambda a, b: _two(value(a) / value(b), a, b, lambda g: g / b, lambda g: -g * a / (b * b)))
rule("negative")(lambda a: _step(-value(a), (a, lambda g: -g)))
rule("exp")(lambda a: _step(np.exp(value(a)), (a, lambda g: g * np.exp(a))))
rule("log")(lambda a: _step(np.log(value(a)), (a, lambda g: g / a)))
rule("sqrt")(lambda a: _step(np.sqrt(value(a)), (a, lambda g: g / (2 * np.sqrt(a)))))
rule("sin")(lambda a: _step(np.sin(value(a)), (a, lambda g: g * np.cos(a))))
rule("cos")(lambda a: _step(np.cos(value(a)), (a, lambda g: -g * np.sin(a))))
rule("tanh")(lambda a: _step(np.tanh(value(a)), (a, lambda g: g * (1 - np.tanh(a) * np.tanh(a)))))
rule("absolute")(lambda a: _step(np.abs(value(a)), (a, lambda g: g * np.sign(value(a)))))
rule("square")(lambda a: a * a)
rule("maximum")(lambda a, b: _two(np.maximum(value(a), value(b)), a, b, lambda g: g * (value(a) >= value(b)).astype(float), lambda g: g * (value(a) < value(b)).astype(float)))
rule("minimum")(lambda a, b: _two(np.minimum(value(a), value(b)), a, b, lambda g: g * (value(a) <= value(b)).astype(float), lambda g: g * (value(a) > value(b)).astype(float)))


@rule("power")
def _power(a, b):
    if isinstance(b, Tape):
        return np.exp(b * np.log(a))
    p = np.asarray(b, float)
    if p.ndim == 0 and p == 0:
        return _step(np.ones_like(value(a)), (a, lambda g: g * 0.0))
    return _step(value(a) ** p, (a, lambda g: g * p if p.ndim == 0 and p == 1 else g * p * a ** (p - 1)))


@rule("matmul")
def _matmul(a, b):
    if value(a).ndim != 2 or value(b).ndim > 2:
        raise TypeError("@ takes rows times a matrix or a vector")
    x = value(a) @ value(b)
    if value(b).ndim == 1:
        return _step(x, (a, lambda g: column(g) * b), (b, lambda g: transposed(a) @ g))
    return _step(x, (a, lambda g: g @ transposed(b)), (b, lambda g: transposed(a) @ g))


def transposed(a):
    return _step(value(a).T, (a, transposed)) if isinstance(a, Tape) else np.asarray(a).T


def column(a):
    """A vector as a matrix of one column."""
    return _step(value(a)[:, None], (a, lambda g: g[:, 0])) if isinstance(a, Tape) else np.asarray(a)[:, None]


def total(a, axis=None, keepdims=False):
    if not isinstance(a, Tape):
        return np.sum(a, axis=axis, keepdims=keepdims)

    def back(g):
        ones = np.ones_like(a.value)
        if axis is None or keepdims:
            return g * ones
        return expanded(g, axis) * ones

    return _step(a.value.sum(axis=axis, keepdims=keepdims), (a, back))


def expanded(g, axis: int):
    return _step(np.expand_dims(value(g), axis), (g, lambda h: total(h, axis))) if isinstance(g, Tape) else np.expand_dims(g, axis)


def taken(a: Tape, at) -> Tape:
    return _step(a.value[at], (a, lambda g: placed(g, at, a.value.shape)))


def placed(g, at, shape: tuple[int, ...]):
    """Zeros with g added at the given places."""
    out = np.zeros(shape)
    np.add.at(out, at, value(g))
    return _step(out, (g, lambda h: h[at])) if isinstance(g, Tape) else out


def stacked(parts, axis: int = 0) -> Tape:
    at = lambda k, n: (slice(None),) * (axis if axis >= 0 else n + axis) + (k,)
    x = np.stack([value(p) for p in parts], axis)
    return _step(x, *((p, lambda g, k=k: g[at(k, x.ndim)]) for k, p in enumerate(parts)))


def gradient(y: Tape, x: Tape) -> Tape:
    """Sensitivity of the sum of y to x, itself on the tape."""
    order, seen, stack = [], set(), [(y, False)]
    while stack:  # operands before results, without recursion
        node, done = stack.pop()
        if done:
            order.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            stack.append((node, True))
            stack += [(a, False) for a, _ in node.steps]
    sensitivity = {id(y): Tape(np.ones_like(y.value))}
    for node in reversed(order):
        g = sensitivity.get(id(node))
        if g is None:
            continue
        for a, back in node.steps:
            more = back(g)
            more = more if isinstance(more, Tape) else Tape(more)
            sensitivity[id(a)] = sensitivity[id(a)] + more if id(a) in sensitivity else more
    return sensitivity.get(id(x), Tape(np.zeros_like(x.value)))


def _columns(y) -> list[Tape]:
    y = y if isinstance(y, Tape) else Tape(y)
    return [y] if y.ndim == 1 else [y[:, k] for k in range(y.shape[1])]


def nabla(f: Function, x: np.ndarray) -> np.ndarray:
    """N x D gradients of a function with one value a row."""
    t = Tape(x)
    y = f(t)
    return gradient(y, t).value if isinstance(y, Tape) else np.zeros_like(t.value)


def jacobian(f: Function, x: np.ndarray) -> np.ndarray:
    """N x P x D."""
    t = Tape(x)
    return np.stack([gradient(c, t).value for c in _columns(f(t))], 1)


def hessian(f: Function, x: np.ndarray) -> np.ndarray:
    """N x D x D of a function with one value a row."""
    t = Tape(x)
    y = f(t)
    if not isinstance(y, Tape):
        return np.zeros((*t.shape, t.shape[1]))
    return np.stack([gradient(c, t).value for c in _columns(gradient(y, t))], 1)


def divergence(f: Function, x: np.ndarray) -> np.ndarray:
    """Trace of the Jacobian of a function from D to D values a row."""
    t = Tape(x)
    return sum(gradient(c, t).value[:, k] for k, c in enumerate(_columns(f(t))))


def laplace(f: Function, x: np.ndarray) -> np.ndarray:
    t = Tape(x)
    y = f(t)
    return sum(gradient(c, t).value[:, k] for k, c in enumerate(_columns(gradient(y, t)))) if isinstance(y, Tape) else np.zeros(len(t))


#: Operators over rows, by name; what they give is flattened by rows.
OPERATORS = {"nabla": nabla, "jacobian": jacobian, "hessian": hessian, "divergence": divergence, "laplace": laplace}


def over(df: DataFrame, f: Function, operator: str = "nabla", out: str = "g") -> DataFrame:
    """(id, out array): an operator of f at every point of df (id, x)."""
    apply, kind = OPERATORS[operator], df.schema["id"].dataType.simpleString()

    def block(ids, m):
        g = apply(f, m) if len(m) else np.zeros((0, 1))
        return {"id": ids[0], out: gram._lists(np.asarray(g).reshape(len(m), -1))}

    return gram.by_block(df, block, f"id {kind}, `{out}` array<double>", 4096)
