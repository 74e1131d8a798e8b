"""Greedy selection of representative points from a table of any size.

Greedy discrepancy needs the mean kernel of each point to all points, N x N work. The exact
choice sums it in bounded groups (gram.sums) and then makes a pass over all rows for each
pick, of which one candidate a task comes back.

Where a block size is asked for, the work is done in levels instead. Points are dealt by id hash into blocks of bounded size; in its
own task each block is replaced by KEPT of its points, chosen greedily so that their
equally weighted mean stands for the block's in the kernel's norm, each carrying an equal
share of the block's weight. Levels repeat, each an eighth of the one before, until one
block is left: the core set, whose weighted mean kernel is that of the whole table but for
the discrepancies of the blocks (independent of each other, so they partly cancel). The
choice is then made in the core set. A table that fits one block is its own core set, and
the choice is the exact greedy one.

Work is then N x BLOCK kernel values, no task holds more than two blocks, and nothing but the
picks reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.spec import KernelSpec
from ..sources.stage import Stage
from . import gram

BLOCK, KEPT = 2048, 256
#: Scores that agree to this many digits are ties, of which the least id is taken.
DIGITS = 12
#: More picks than this are shared out among the blocks instead of made in one core set.
CORE_PICKS = 1024


def greedy_discrepancy(x: np.ndarray, n: int, spec: KernelSpec, start: tuple[int, ...] = (), weights: np.ndarray | None = None) -> np.ndarray:
    """Places of n points that greedily minimise the kernel discrepancy to all of x
    (weighted); the first on ties. No N x N matrix is kept.
    """
    w = np.full(len(x), 1 / max(1, len(x))) if weights is None else weights / weights.sum()
    potential = np.concatenate([kernels.block(spec, x[s : s + 512], x) @ w for s in range(0, len(x), 512)] or [np.zeros(0)])
    diag = np.array([kernels.block(spec, r[None], r[None])[0, 0] for r in x])
    picked, sums, inner, cross = [], np.zeros(len(x)), 0.0, 0.0
    forced = list(start)
    while len(picked) < min(n, len(x)):
        m = len(picked) + 1
        # of the set with each candidate: mean k in the set - 2 mean k to x
        score = (inner + 2 * sums + diag) / m**2 - 2 * (cross + potential) / m
        score[picked] = np.inf
        i = forced.pop(0) if forced else int(np.argmin(score))
        inner += 2 * sums[i] + diag[i]
        cross += potential[i]
        picked.append(i)
        sums += kernels.block(spec, x, x[i : i + 1])[:, 0]
    return np.array(picked, int)


def sizes_for(n: int, block: int = BLOCK, kept: int = KEPT) -> tuple[int, int]:
    """Rows of a block and rows kept of it when n points are wanted."""
    kept = max(kept, min(n, CORE_PICKS))
    return max(block, 8 * kept), kept


def _dealt(points: DataFrame, n_blocks: int) -> DataFrame:
    """(id, x, w, b) in order of block and id, blocks spread over tasks."""
    tasks = max(1, min(n_blocks, 4096))
    dealt = points.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).repartition(tasks, "b")
    return dealt.sortWithinPartitions("b", "id").select("id", "x", "w", "b")


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """Ids, points, weights and number of each block; a block is cut at most rows."""
    held: list[pa.RecordBatch] = []

    def joined():
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column(0).combine_chunks() if isinstance(t.column(0), pa.ChunkedArray) else t.column(0)
        return ids, gram.rows_of(t.column(1).combine_chunks()), t.column(2).to_numpy(), t.column(3)[0].as_py()

    for batch in batches:
        b = batch.column(3).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
        for s, e in zip(edges, edges[1:]):
            while s < e:
                size = sum(x.num_rows for x in held)
                if held and (held[0].column(3)[0].as_py() != b[s] or size >= most):
                    yield joined()
                    held, size = [], 0
                take = min(e - s, most - size)
                held.append(batch.slice(s, take))
                s += take
    if held:
        yield joined()


def thinned(points: DataFrame, n_blocks: int, kept: int, spec: KernelSpec, most: int) -> DataFrame:
    """One level: (id, x, w) with kept rows of each block."""
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, w, _ in _blocks(batches, most):
            at = greedy_discrepancy(x, kept, spec, weights=w)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), gram._lists(x[at]), pa.array(np.full(len(at), w.sum() / len(at)))], names=["id", "x", "w"])

    return _dealt(points, n_blocks).mapInArrow(run, f"id {kind}, x array<double>, w double")


class CoreSet:
    """(id, x, w) of at most block rows that stand for a table; drop() deletes it."""

    def __init__(self, df: DataFrame, spec: KernelSpec, block: int = BLOCK, kept: int = KEPT):
        self.rows, self._stage, n = df.select("id", "x", F.lit(1.0).alias("w")), None, df.count()
        self.size = n
        while self.size > block:
            before = self._stage
            self._stage = Stage(thinned(self.rows, -(-self.size * 5 // (4 * block)), kept, spec, 2 * block), "core")
            self.rows = self._stage.rows
            if before is not None:
                before.drop()
            self.size = self.rows.count()

    def drop(self) -> None:
        if self._stage is not None:
            self._stage.drop()


def _in_one_task(core: CoreSet, fun, schema: str) -> DataFrame:
    """fun(ids, x, w) -> columns, over the rows of a core set in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is not None and t.num_rows:
            cols = fun(t.column(0).combine_chunks(), gram.rows_of(t.column(1).combine_chunks()), t.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return core.rows.repartition(1).sortWithinPartitions("id").mapInArrow(run, schema)


def exact_picks(df: DataFrame, n: int, spec: KernelSpec) -> list[tuple]:
    """(id, x, rank) of the n points that greedily minimise the discrepancy to all of df
    (id, x): the mean kernel of each row is summed once, then each pick is a pass over the
    rows that scores them against the picks so far."""
    sums = gram.sums(points := df.select("id", "x"), points, spec).select("id", "w")
    known = Stage(points.join(sums, "id"), "potential")
    rows, kind = known.rows.count(), df.schema["id"].dataType.simpleString()
    ids, at, inner, cross, picks = [], np.zeros((0, 0)), 0.0, 0.0, []

    def best(ids, at, inner, cross):
        m = len(ids) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left = batch.filter(pc.invert(pc.is_in(batch.column(0), value_set=pa.array(ids, batch.schema.field(0).type))))
                if not left.num_rows:
                    continue
                x, mean = gram.rows_of(left.column(1)), left.column(2).to_numpy() / rows
                sums = gram.tile_sums(gram.kernel_fun(spec), x, at)[:, 0] if ids else np.zeros(len(x))
                own = np.array([kernels.block(spec, r[None], r[None])[0, 0] for r in x])
                score = np.round((inner + 2 * sums + own) / m**2 - 2 * (cross + mean) / m, DIGITS)
                tied = np.flatnonzero(score == score.min())
                k = int(tied[pc.sort_indices(left.column(0).take(pa.array(tied)))[0].as_py()])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in ([score[k]], [mean[k]], [sums[k]], [own[k]])] + [left.column(0).slice(k, 1), left.column(1).slice(k, 1)], names=["score", "mean", "sums", "own", "id", "x"])

        found = known.rows.select("id", "x", "w").mapInArrow(run, f"score double, mean double, sums double, own double, id {kind}, x array<double>")
        return found.orderBy("score", "id").limit(1).collect()

    while len(ids) < min(n, rows):
        if not (top := best(ids, at, inner, cross)):
            break
        r = top[0]
        picks.append((r["id"], r["x"], len(ids)))
        inner, cross = inner + 2 * r["sums"] + r["own"], cross + r["mean"]
        ids, at = [*ids, r["id"]], np.array([v for _, v, _ in picks], float)
    known.drop()
    return picks


def greedy_picks(df: DataFrame, n: int, spec: KernelSpec, block: int | None = None, kept: int = KEPT) -> DataFrame:
    """(id, x, rank): n points of df (id, x) chosen greedily, ranks from 0 in order of choice;
    the exact choice, or with a block size that of a core set.

    Beyond CORE_PICKS points every block brings its share of n, in its own order of choice;
    ranks then grow but are not dense, and a block with fewer rows than its share brings all.
    """
    kind = df.schema["id"].dataType.simpleString()
    schema = f"id {kind}, x array<double>, rank long"
    if block is None and n <= CORE_PICKS:
        if df.count() > BLOCK:
            return df.sparkSession.createDataFrame(exact_picks(df, n, spec), df.select("id", "x", F.lit(0).cast("long").alias("rank")).schema)
    block = block or BLOCK
    if n <= CORE_PICKS:
        core = CoreSet(df, spec, *sizes_for(n, block, kept))

        def pick(ids, x, w):
            at = greedy_discrepancy(x, n, spec, weights=w)
            return {"id": ids.take(pa.array(at)), "x": gram._lists(x[at]), "rank": pa.array(np.arange(len(at)))}

        return _in_one_task(core, pick, schema)
    blocks = max(1, -(-df.count() * 5 // (4 * block)))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, 0
        for ids, x, w, b in _blocks(batches, 2 * block):
            left = n * (b + 1) // blocks - n * b // blocks if b != last else left
            last = b
            at = greedy_discrepancy(x, left, spec, weights=w)
            left -= len(at)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), gram._lists(x[at]), pa.array(np.arange(len(at)) * blocks + b)], names=["id", "x", "rank"])

    return _dealt(df.select("id", "x", F.lit(1.0).alias("w")), blocks).mapInArrow(share, schema)


def summed(df: DataFrame, fun, cells: int) -> np.ndarray:
    """Sum over all points of fun(X) (an array of cells numbers for a block of points):
    a partial sum a task, then one mergeable sum a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            x = gram.rows_of(batch.column(0))
            for s in range(0, len(x), 1024):
                total += fun(x[s : s + 1024])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["c", "v"])

    found = df.select("x").mapInArrow(run, "c long, v double").groupBy("c").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(cells)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


#: Step lengths that one pass tries, each half the one before.
TRIALS = 8


def descend(df: DataFrame, rows: int, y: np.ndarray, spec: KernelSpec, rounds: int = 10) -> np.ndarray:
    """Points y moved along the negative gradient of their discrepancy to all rows of df.

    A round is two passes of sums: the gradient, then the discrepancy after TRIALS step
    lengths at once, of which the longest that lowers it is taken; the next round starts
    from one and a half times that length.
    """
    y, m, step = y.copy(), len(y), 1.0
    pull = lambda p: lambda x: np.array([kernels.block(spec, q, x).sum() for q in p])
    own = lambda p: kernels.block(spec, p, p).mean()
    now = own(y) - 2 * summed(df, pull([y]), 1)[0] / (m * rows)
    for _ in range(rounds):

        def slope(x, y=y):
            parts = max(1, 4_000_000 // max(1, x.size))
            return np.concatenate([kernels.gradient_block(spec, y[s : s + parts], x).sum(1).ravel() for s in range(0, m, parts)])

        g = 2 * kernels.gradient_block(spec, y, y).sum(1) / m**2 - 2 * summed(df, slope, y.size).reshape(y.shape) / (m * rows)
        trials = [y - step / 2**k * m * g for k in range(TRIALS)]
        after = [own(p) - 2 * s / (m * rows) for p, s in zip(trials, summed(df, pull(trials), TRIALS))]
        better = next((k for k, v in enumerate(after) if v < now), None)
        if better is None:
            break
        y, now, step = trials[better], after[better], step / 2**better * 1.5
    return y


def picked(df: DataFrame, n: int, spec: KernelSpec, block: int | None = None) -> np.ndarray:
    """The points of greedy_picks in order of choice; n of checked size."""
    if n > gram.CENTRES:
        raise ValueError(f"{n} points; at most {gram.CENTRES} are collected")
    found = greedy_picks(df, n, spec, block).select("rank", "x").toArrow().sort_by("rank")
    return gram.rows_of(found.column("x").combine_chunks())
