"""Least-cost assignment with whole-number costs by shortest augmenting paths.

Duals u, v with c - u - v >= 0 everywhere and = 0 on every matched pair prove a matching
least. A phase searches from all free rows at once, in whole steps of distance, raises u and
lowers v by what was searched, and augments one path in every tree that met a free column.

Rows are searched by short lists of their nearest columns under the prices. v only falls
within the search, so a list holds all that counts until u reaches its bound (the last value
listed); then a longer list of that row is asked for. Nothing is left out: the result is
exact however long the lists are. Rows of equal costs are one class and share a list.

prices() finds good prices to begin with, by scaling rows and columns at falling temperatures.
They only shorten the search.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FAR = np.int64(1) << 60
#: Trees that have to meet a free column before a phase ends, as a share of all.
SHARE = 0.05
#: Temperatures of the scaling passes, as parts of the spread of the costs.
COOLING = (4, 6, 8, 12, 12, 16, 16, 24, 24, 32, 32, 48, 48)
#: (rows, widths, prices) -> lengths, columns, costs and bounds of the lists, in order of rows.
Near = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def prices(n: int, spread: float, passes: Callable[[np.ndarray, float], np.ndarray]) -> np.ndarray:
    """Whole prices of n columns. passes(prices, t): the sums over rows of exp((price - cost) / t),
    each row scaled to a sum of one."""
    v = np.zeros(n)
    for part in COOLING if spread > 0 and n > 2 else ():
        t = spread / part
        v = v - t * np.log(np.maximum(passes(v, t), 1e-9))
        v -= v.mean()
    return np.rint(v).astype(np.int64)


class _Lists:
    """The list of each class, in one pool."""

    def __init__(self, rows: np.ndarray, near: Near, width: int, v: np.ndarray):
        k = len(rows)
        self.rows, self.near, self.width = rows, near, np.full(k, min(len(v), width))
        self.start, self.length, self.bound = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        self.columns, self.costs = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.ask(np.arange(k), v)

    def ask(self, kinds: np.ndarray, v: np.ndarray) -> None:
        length, columns, costs, self.bound[kinds] = self.near(self.rows[kinds], self.width[kinds], v)
        self.start[kinds], self.length[kinds] = len(self.columns) + np.cumsum(length) - length, length
        self.columns, self.costs = np.concatenate([self.columns, columns]), np.concatenate([self.costs, costs])
        if len(self.columns) > 2 * self.length.sum():
            at, _ = self.of(np.arange(len(self.start)))
            self.columns, self.costs, self.start = self.columns[at], self.costs[at], np.cumsum(self.length) - self.length

    def of(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of the given classes, and which of these each belongs to."""
        length = self.length[kinds]
        which = np.repeat(np.arange(len(kinds)), length)
        return np.arange(len(which)) + (self.start[kinds] - np.cumsum(length) + length)[which], which


def solve(v: np.ndarray, near: Near, width: int, classes: np.ndarray, margin: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each row, u, v) of a least assignment of n rows to n columns, from prices v.
    classes: a number of each row, the same for rows of equal costs."""
    n, v = len(v), v.copy()
    _, heads, classes = np.unique(classes, return_index=True, return_inverse=True)
    lists = _Lists(heads, near, width, v)
    at, which = lists.of(np.arange(len(heads)))
    u = np.full(len(heads), FAR)
    np.minimum.at(u, which, lists.costs[at] - v[lists.columns[at]])
    u = u[classes]
    place, owner = np.full(n, -1), np.full(n, -1)
    while (place < 0).any():
        short = _phase(lists, u, v, place, owner, classes, margin)
        if short.size:
            lists.width[short] = np.minimum(n, 2 * lists.width[short])
            lists.ask(short, v)
    return place, u, v


def _phase(lists: _Lists, u: np.ndarray, v: np.ndarray, place: np.ndarray, owner: np.ndarray, classes: np.ndarray, margin: int) -> np.ndarray:
    """Search, new duals, augmentation; the classes whose lists end within the margin, if one ended."""
    n = len(u)
    column, row, parent, root, got = (np.full(n, f) for f in (FAR, FAR, -1, -1, -1))
    done, first = np.zeros(n, bool), np.full(len(lists.rows), FAR)  # first: least d - u of a class
    pending: dict[int, list[np.ndarray]] = {}
    free = np.flatnonzero(place < 0)
    row[free], root[free] = 0, free
    d, limit, met = 0, FAR, 0

    def enter(rows: np.ndarray) -> np.ndarray:
        nonlocal limit
        kinds, key = classes[rows], d - u[rows]
        before = first[kinds]
        np.minimum.at(first, kinds, key)
        sooner = (key < before) & (key == first[kinds])  # the others of a class meet nothing new
        rows, kinds = rows[sooner], kinds[sooner]
        if rows.size:
            limit = min(limit, (lists.bound[kinds] + first[kinds]).min())
        return rows[np.argsort(kinds, kind="stable")]

    def settle(js: np.ndarray) -> np.ndarray:
        nonlocal met
        done[js] = True
        tree, own = root[parent[js]], owner[js]
        ends, new = tree[own < 0], js[own < 0]
        new, ends = new[got[ends] < 0], ends[got[ends] < 0]
        ends, at = np.unique(ends, return_index=True)
        got[ends] = new[at]
        met += len(ends)
        own, tree = own[own >= 0], tree[own >= 0]
        row[own], root[own] = d, tree
        return enter(own)

    frontier = enter(free)
    while True:
        while frontier.size:
            kinds, begin, members = np.unique(classes[frontier], return_index=True, return_counts=True)
            at, which = lists.of(kinds)
            j = lists.columns[at]
            reach = np.maximum(d, lists.costs[at] + first[kinds][which] - v[j])
            ok = np.flatnonzero((reach < column[j]) & (reach <= limit) & ~done[j])
            j, reach, which = j[ok].astype(np.int64), reach[ok], which[ok]
            # the list of a class is dealt among its rows
            i = frontier[begin[which] + (at[ok] - lists.start[kinds][which]) % members[which]]
            if not j.size:
                break
            # columns wanted by many rows at one distance are dealt among them
            dealt = ((i * 2654435761 + j * 40503) >> 7) & 4095
            far = reach - d
            order = np.argsort((j << 36) + (far << 12) + dealt) if far.max() < 1 << 24 else np.lexsort((dealt, far, j))
            order = order[np.unique(j[order], return_index=True)[1]]
            j, reach, i = j[order], reach[order], i[order]
            column[j], parent[j] = reach, i
            later = reach > d
            if later.any():
                order = np.argsort(reach[later], kind="stable")
                steps, starts = np.unique(reach[later][order], return_index=True)
                for s, part in zip(steps.tolist(), np.split(j[later][order], starts[1:])):
                    pending.setdefault(s, []).append(part)
            frontier = settle(j[~later])
        if met and met >= SHARE * len(free):
            break
        js = np.zeros(0, int)
        while not js.size and pending and (s := min(pending)) <= limit:
            js = np.unique(np.concatenate(pending.pop(s)))
            js = js[(column[js] == s) & ~done[js]]
        if not js.size:
            d = limit
            break
        d = s
        frontier = settle(js)
    up, down = row < d, done & (column < d)
    u[up] += d - row[up]
    v[down] -= d - column[down]
    j = got[got >= 0]
    while j.size:
        i = parent[j]
        before = place[i]
        place[i], owner[j] = j, i
        j = before[before >= 0]
    return np.flatnonzero((first < FAR) & (lists.bound + first - d <= margin)) if d >= limit else np.zeros(0, int)
