"""Black-box optimisers: screening by draws, contraction, a line search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gram


def screen(f: Callable[[np.ndarray], np.ndarray], draws: DataFrame, maximize: bool = True) -> tuple[np.ndarray, float]:
    """Best of a frame of draws (id, x); f maps a block of rows to values. One pass; the
    frame is reduced to its best row."""
    kind = draws.schema["id"].dataType.simpleString()
    scored = gram.by_block(draws, lambda ids, m: {"id": ids[0], "x": gram._lists(m), "v": pa.array(np.asarray(f(m), float).ravel())}, f"id {kind}, x array<double>, v double", 1024)
    pick = F.max_by if maximize else F.min_by
    sign = F.struct(F.col("v"), (-F.col("id") if maximize else F.col("id")).alias("i"))
    row = scored.agg(pick(F.struct("x", "v"), sign).alias("best")).head()["best"]
    return np.array(row["x"]), row["v"]


def continuous(f, draw: Callable[[np.ndarray | None, float, int], DataFrame], n_iter: int = 5, contraction: float = 0.3, maximize: bool = True, include: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Screening repeated on draws contracted about the best point so far.

    draw(centre, scale, round) gives the frame of a round; the first has no centre.
    """
    best, value = None, None
    if include is not None and len(include):
        v = np.asarray(f(include), float).ravel()
        k = int(v.argmax() if maximize else v.argmin())
        best, value = include[k], float(v[k])
    scale = 1.0
    for r in range(n_iter):
        x, v = screen(f, draw(best, scale, r), maximize)
        if value is None or (v > value if maximize else v < value):
            best, value = x, v
        elif r:
            break
        scale *= contraction
    return best, value


def golden(g: Callable[[float], float], low: float, high: float, rounds: int = 60) -> float:
    """Minimum of a function of one number on an interval, by golden sections."""
    r = (5**0.5 - 1) / 2
    a, b = low, high
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = g(c), g(d)
    for _ in range(rounds):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = g(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = g(d)
    return (a + b) / 2


def gradient(f, grad, draw, n_iter: int = 5, contraction: float = 0.3, maximize: bool = True, reach: float = 1.0) -> tuple[np.ndarray, float]:
    """Contraction, then one line search along the normalised gradient."""
    x, v = continuous(f, draw, n_iter, contraction, maximize)
    g = np.asarray(grad(x[None])).ravel()
    size = np.linalg.norm(g)
    if size == 0:
        return x, v
    way = g / size * (1 if maximize else -1)
    sign = -1 if maximize else 1
    t = golden(lambda s: sign * float(np.ravel(f((x + s * way)[None]))[0]), 0.0, reach)
    best = float(np.ravel(f((x + t * way)[None]))[0])
    return (x + t * way, best) if (best > v if maximize else best < v) else (x, v)
