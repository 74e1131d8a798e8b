"""Gram and distance matrices, nearest neighbours, and the sums built from them.

Centres Y are bounded (CENTRES) and go out with the tasks; the left side is read
once, block by block, one matrix product a block. More centres than that are cut
into groups with a pass each, whose partial sums add up, so no table of N x M pairs is
ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.maps import MapChain
from ..plans.spec import KernelSpec
from ..sources.stage import Stage

#: Centres in one broadcast: at 64 dimensions 8 MB.
CENTRES = 16_384
#: Cells of one kernel block.
CELLS = 4_000_000
#: Rows and columns of a tile of kernel sums, which stays in a core's cache.
TILE = 256, 1024


@dataclass
class Centres:
    ids: np.ndarray
    x: np.ndarray
    f: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.ids)

    def parts(self, size: int = CENTRES) -> list["Centres"]:
        return [Centres(self.ids[k : k + size], self.x[k : k + size], None if self.f is None else self.f[k : k + size]) for k in range(0, len(self), size)]


def centres(df: DataFrame, values: str | list[str] | None = None, limit: int = CENTRES, id_column: str = "id", x: str = "x") -> Centres:
    """Collect a point set of checked size, in order of id; a larger one raises."""
    cols = [values] if isinstance(values, str) else list(values or [])
    t = df.select(id_column, x, *cols).limit(limit + 1).toArrow()
    n = t.num_rows
    if n > limit:
        raise ValueError(f"{df.count()} centres; at most {limit} are collected: choose representative points first")
    t = t.sort_by(id_column).combine_chunks()
    f = np.array([np.array(t.column(2 + k).to_pylist(), float) for k in range(len(cols))]).T if cols else None
    at = t.column(1).combine_chunks()
    return Centres(np.array(t.column(0).to_pylist()), rows_of(at) if n else np.zeros((0, 0)), f)


def centre_groups(df: DataFrame, values: str | list[str] | None = None, id_column: str = "id", x: str = "x", size: int = CENTRES) -> Iterator[Centres]:
    """A point set of any size in groups of about size, dealt by hash of the id; empty groups
    are left out. The groups are written apart once, so that each is read alone."""
    n = df.count()
    if n <= size:
        yield centres(df, values, size * 2, id_column, x)
        return
    apart, k = _dealt(df, n, values, id_column, x, size)
    for g in range(k):
        found = centres(apart.rows.where(F.col("g") == g), values, size * 2, id_column, x)
        if len(found):
            yield found
    apart.drop()


def _dealt(df: DataFrame, n: int, values: str | list[str] | None, id_column: str, x: str, size: int) -> tuple[Stage, int]:
    """(the n points with the number g of their group, in order of g; groups)."""
    k = -(-n * 5 // (4 * size))
    cols = [values] if isinstance(values, str) else list(values or [])
    dealt = df.select(id_column, x, *cols).withColumn("g", F.pmod(F.xxhash64(id_column), F.lit(k)))
    return Stage(dealt.repartition(k, "g").sortWithinPartitions("g"), "groups"), k


def rows_of(column: pa.Array) -> np.ndarray:
    """An Arrow list<double> column as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0)
    return np.asarray(flat, float).reshape(n, -1) if n else np.zeros((0, 1))


def by_block(df: DataFrame, fun: Callable[[list, np.ndarray], dict], schema: str, width: int, id_column: str = "id", x: str = "x", more: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over blocks of points: fun(ids and more columns, X) -> columns."""
    step = max(1, CELLS // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                cols = fun([part.column(0), *(part.column(2 + k) for k in range(len(more)))], rows_of(part.column(1)))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return df.select(id_column, x, *more).mapInArrow(run, schema)


def _lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.size else np.zeros(len(m) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def kernel_fun(spec: KernelSpec, chain: MapChain | None = None, distance: str | None = "kernel") -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Block function of a kernel, or of a distance (None: the kernel's own)."""
    f = (lambda a: chain.apply(a)) if chain else (lambda a: a)
    if distance == "kernel":
        return lambda a, b: kernels.block(spec, f(a), f(b))
    return lambda a, b: kernels.distance_block(f(a), f(b), distance, spec)


def tile_sums(fun: Callable[[np.ndarray, np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray, f: np.ndarray | None = None, apart: tuple[np.ndarray, np.ndarray] | None = None, back: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Row sums of K(a, b), followed by K(a, b) f, tile by tile; apart: places (of a, of b)
    whose kernel counts as 0; back: (v, total), K(a, b)' v is added to total."""
    ones = np.ones((len(b), 1))
    g = ones if f is None else np.concatenate([ones, f], 1)
    out, (rows, columns) = np.zeros((len(a), g.shape[1])), TILE
    for r in range(0, len(a), rows):
        for c in range(0, len(b), columns):
            k = fun(a[r : r + rows], b[c : c + columns])
            if apart is not None:
                at = (apart[0] >= r) & (apart[0] < r + rows) & (apart[1] >= c) & (apart[1] < c + columns)
                k[apart[0][at] - r, apart[1][at] - c] = 0.0
            out[r : r + rows] += k @ g[c : c + columns]
            if back is not None:
                back[1][c : c + columns, : back[0].shape[1]] += k.T @ back[0][r : r + rows]
    return out


def same_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (of a, of b) of equal ids."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    counts = high - low
    first = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(a) else np.zeros(0, int)
    return np.repeat(np.arange(len(a)), counts), order[first + np.arange(counts.sum())]


def knm(x: DataFrame, y: Centres, spec: KernelSpec | str, theta: np.ndarray | None = None, chain: MapChain | None = None) -> DataFrame:
    """(id, k array): rows of K(x, y), or of K(x, y) theta, which is never formed apart."""
    spec = KernelSpec(spec) if isinstance(spec, str) else spec
    fun = kernel_fun(spec, chain)
    kind = x.schema["id"].dataType.simpleString()

    def block(ids, m):
        k = fun(m, y.x)
        return {"id": ids[0], "k": _lists(k if theta is None else k @ theta)}

    return by_block(x, block, f"id {kind}, k array<double>", len(y))


def dnm(x: DataFrame, y: Centres, distance: str | None = "norm22", spec: KernelSpec | str = "gaussian", chain: MapChain | None = None) -> DataFrame:
    fun = kernel_fun(KernelSpec(spec) if isinstance(spec, str) else spec, chain, distance)
    kind = x.schema["id"].dataType.simpleString()
    return by_block(x, lambda ids, m: {"id": ids[0], "d": _lists(fun(m, y.x))}, f"id {kind}, d array<double>", len(y))


def pairs(x: DataFrame, y: DataFrame, value: Callable, out: str = "k", y_rows: int = 4096) -> DataFrame:
    """(x_id, y_id, value): the column form, for a few centres; their number is checked
    and they go into the plan as one literal array, so there is no join."""
    c = centres(y, limit=y_rows)
    lit = F.array(*(F.struct(F.lit(i.item() if hasattr(i, "item") else i).alias("id"), F.array(*map(F.lit, map(float, v))).alias("x")) for i, v in zip(c.ids, c.x)))
    return x.select(F.col("id").alias("x_id"), "x", F.explode(lit).alias("y")).select("x_id", F.col("y.id").alias("y_id"), value(F.col("x"), F.col("y.x")).alias(out))


def labelled(x: DataFrame, y: Centres, distance: str | None = "norm2", maxmin: str = "min", spec: KernelSpec | str = "gaussian", labels: np.ndarray | None = None) -> DataFrame:
    """(id, label, distance): nearest or farthest centre, the lowest place on ties."""
    fun = kernel_fun(KernelSpec(spec) if isinstance(spec, str) else spec, None, distance)
    names = y.ids if labels is None else labels
    kind = x.schema["id"].dataType.simpleString()
    is_text = names.dtype.kind in "UO"

    def block(ids, m):
        d = fun(m, y.x)
        at = d.argmin(1) if maxmin == "min" else d.argmax(1)
        return {"id": ids[0], "label": pa.array(names[at].tolist(), pa.string() if is_text else pa.int64()), "distance": pa.array(d[np.arange(len(d)), at])}

    return by_block(x, block, f"id {kind}, label {'string' if is_text else 'long'}, distance double", len(y))


def sums(x: DataFrame, y: DataFrame, spec: KernelSpec | str, values: list[str] | None = None, leave_one_out: bool = False, chain: MapChain | None = None, size: int = CENTRES, of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, w, s array): sum over y of k(x, y), and of k(x, y) times each value, or each
    column that of() makes from the values of y.

    Both sides of any size. y in groups of about size centres, one pass over x each, partial
    sums added by id, so that the result has one row an id (ids of x are distinct); if y is
    the larger side and x fits size, one pass over y with x in every task. Of one frame
    with itself (x is y) every two groups meet once, as k(x, y) = k(y, x).
    """
    spec = KernelSpec(spec) if isinstance(spec, str) else spec
    fun, mapped = kernel_fun(spec), (chain.apply if chain else lambda m: m)
    kind = x.schema["id"].dataType.simpleString()
    target = of or (lambda f: f)
    n = target(np.zeros((1, len(values)))).shape[1] if values else 1
    if x is y and (rows := y.count()) > size:
        return _summed_by_id(_mutual(y, rows, fun, mapped, values, leave_one_out, target, n, size), n)
    if x is not y and y.count() > size >= x.count():
        return _summed_by_id(_streamed(x, y, fun, mapped, values, leave_one_out, target, n), n)
    out, parts = None, 0
    for y_part in centre_groups(y, values, size=size):

        def block(ids, m, c=y_part, f=None if y_part.f is None else target(y_part.f)):
            apart = same_ids(np.array(ids[0].to_pylist()), c.ids) if leave_one_out else None
            k = tile_sums(fun, mapped(m), mapped(c.x), f, apart)
            return {"id": ids[0], "w": pa.array(k[:, 0]), "s": _lists(k[:, 1:] if f is not None else np.zeros((len(k), 1)))}

        part = by_block(x, block, f"id {kind}, w double, s array<double>", 1024)
        out, parts = part if out is None else out.unionByName(part), parts + 1
    return out if parts < 2 else _summed_by_id(out, n)


def _mutual(y: DataFrame, rows: int, fun, mapped, values: list[str] | None, leave_one_out: bool, target, n: int, size: int) -> DataFrame:
    """Partial sums of a frame with itself: a group goes to the rows of its own and of earlier
    groups, and each task adds to these rows and, from earlier groups, to the group as well."""
    apart, groups = _dealt(y, rows, values, "id", "x", size)
    cols, kind, out = values or [], y.schema["id"].dataType.simpleString(), None
    for g in range(groups):
        c = centres(apart.rows.where(F.col("g") == g), values, size * 2)
        if not len(c):
            continue

        def run(batches: Iterator[pa.RecordBatch], g=g, c=c) -> Iterator[pa.RecordBatch]:
            at, f = mapped(c.x), None if c.f is None else target(c.f)
            total = np.zeros((len(c), n + 1))

            def record(ids, sums):
                return pa.RecordBatch.from_arrays([ids, pa.array(sums[:, 0]), _lists(sums[:, 1:] if values else np.zeros((len(sums), 1)))], names=["id", "w", "s"])

            for batch in batches:
                own = batch.column(2).to_numpy() == g
                for part, inside in ((batch.filter(pa.array(own)), True), (batch.filter(pa.array(~own)), False)):
                    if not part.num_rows:
                        continue
                    fr = target(np.stack([part.column(3 + k).to_numpy(zero_copy_only=False) for k in range(len(cols))], 1).astype(float)) if values else None
                    apart_ = same_ids(np.array(part.column(0).to_pylist()), c.ids) if leave_one_out and inside else None
                    back = None if inside else (np.ones((part.num_rows, 1)) if fr is None else np.concatenate([np.ones((part.num_rows, 1)), fr], 1), total)
                    yield record(part.column(0), tile_sums(fun, mapped(rows_of(part.column(1))), at, f, apart_, back))
            if total.any():
                yield record(pa.array(c.ids.tolist(), batch.schema.field(0).type), total)

        part = apart.rows.where(F.col("g") <= g).select("id", "x", "g", *cols).mapInArrow(run, f"id {kind}, w double, s array<double>")
        out = part if out is None else out.unionByName(part)
    return out


def _summed_by_id(parts: DataFrame, n: int) -> DataFrame:
    return parts.groupBy("id").agg(F.sum("w").alias("w"), F.array(*(F.sum(F.get("s", F.lit(k))) for k in range(n))).alias("s"))


def _streamed(x: DataFrame, y: DataFrame, fun, mapped, values: list[str] | None, leave_one_out: bool, target, n: int) -> DataFrame:
    """Partial sums of each task of y, a row a point of x."""
    c, kind = centres(x), x.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros((len(c), n + 1)), mapped(c.x)
        for batch in batches:
            points = rows_of(batch.column(1))
            f = target(np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(len(values))], 1).astype(float)) if values else None
            apart = same_ids(c.ids, np.array(batch.column(0).to_pylist())) if leave_one_out else None
            found = tile_sums(fun, at, mapped(points), f, apart)
            total[:, : found.shape[1]] += found
        w, s = total[:, 0], total[:, 1:]
        yield pa.RecordBatch.from_arrays([pa.array(c.ids.tolist()), pa.array(w), _lists(s)], names=["id", "w", "s"])

    return y.select("id", "x", *(values or [])).mapInArrow(run, f"id {kind}, w double, s array<double>")


def mean_kernel(x: DataFrame, y: DataFrame, spec: KernelSpec | str, chain: MapChain | None = None) -> float:
    """Mean of k over all pairs, as one number per pass and block."""
    n = y.count()
    return sums(x, y, spec, chain=chain).agg(F.sum("w") / F.count_distinct("id") / n).head()[0]


def discrepancy(x: DataFrame, z: DataFrame, spec: KernelSpec | str, chain: MapChain | None = None) -> float:
    """Squared kernel discrepancy: mean k(x,x) - 2 mean k(x,z) + mean k(z,z)."""
    return mean_kernel(x, x, spec, chain) - 2 * mean_kernel(x, z, spec, chain) + mean_kernel(z, z, spec, chain)


def discrepancy_to(x: DataFrame, ys: DataFrame, spec: KernelSpec | str) -> DataFrame:
    """(id, value) of each y: 1 + mean k(x,x) - 2 mean over x of k(y, x); needs k(y,y) = 1."""
    kxx, n = mean_kernel(x, x, spec), x.count()
    return sums(ys, x, spec).select("id", (F.lit(1.0) + F.lit(kxx) - 2 * F.col("w") / n).alias("value"))


def cartesian(x: DataFrame, y: DataFrame, how: str = "outer", y_rows: int = 4096) -> DataFrame:
    """(x_id, y_id, x): concatenation (outer) or sum of each pair, y of checked size."""
    value = (lambda a, b: F.concat(a, b)) if how == "outer" else (lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
    return pairs(x, y, value, "x", y_rows)
