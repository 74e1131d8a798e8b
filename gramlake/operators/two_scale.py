"""Two-scale kernel regression: a coarse model on given centres, and one model of its
residuals for each of their clusters (the points nearest to a centre).

A cluster may hold most of the rows, so no cluster's rows are brought together. Its fine
centres are the points of least hash, at most most of them, found among the few whose hash
lies below a limit that follows from the cluster's size. With the centres of all clusters
in every task, each task sums its share of the normal equations of every cluster it meets;
only these sums are shuffled, a row of the system at a time, and solved by cluster. A
cluster with no more points than that is interpolated at all of them, in one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.spec import KernelSpec
from ..sources.stage import Stage
from . import gram, linalg, model
from .gram import Centres

#: Fine centres of all clusters together, which go to every task.
ALL_CENTRES = 262_144


def _routed(df: DataFrame, values: list[str], coarse, centres: Centres) -> DataFrame:
    """(cluster, x, r, h): nearest centre, residual of the coarse model, hash of the point."""

    def block(ids, m):
        f = np.stack([c.to_numpy(zero_copy_only=False) for c in ids[1:]], 1).astype(float)
        return {"cluster": pa.array(kernels.sq_dist(m, centres.x).argmin(1), pa.int64()), "x": gram._lists(m), "r": gram._lists(f - coarse.values(m))}

    return gram.by_block(df, block, "cluster long, x array<double>, r array<double>", len(centres), more=tuple(values)).withColumn("h", F.xxhash64("x"))


def least_hashes(routed: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(cluster, x): the most points of least hash of each cluster. Twice as many are
    expected below the limit; only those are ranked."""
    share = F.least(F.lit(1.0), F.lit(2.0 * most + 64) / F.col("n"))
    low = routed.join(F.broadcast(sizes), "cluster").where(F.col("h") / 2.0**64 + 0.5 <= share)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("h", "x"))
    return low.select("cluster", "x", "h").distinct().withColumn("k", rank).where(F.col("k") <= most).select("cluster", "x", "k")


def _parts(big: DataFrame, fine: dict[int, np.ndarray], kernel, outputs: int) -> DataFrame:
    """(cluster, row, sums): rows of K'K and K'r side by side, summed over each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            of, x, r = batch.column(0).to_numpy(), gram.rows_of(batch.column(1)), gram.rows_of(batch.column(2))
            for c in np.unique(of).tolist():
                y, at = fine[c], np.flatnonzero(of == c)
                step = max(1, gram.CELLS // len(y))
                for s in range(0, len(at), step):
                    k = kernel(x[at[s : s + step]], y)
                    more = np.concatenate([k.T @ k, k.T @ r[at[s : s + step]]], 1)
                    sums[c] = sums[c] + more if c in sums else more
        for c, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), c)), pa.array(np.arange(len(m))), gram._lists(m)], names=["cluster", "row", "sums"])

    def added(table: pa.Table) -> pa.Table:
        m = gram.rows_of(table.column("sums").combine_chunks())
        return pa.table({"cluster": table.column("cluster").slice(0, 1), "row": table.column("row").slice(0, 1), "sums": gram._lists(m.sum(0, keepdims=True))})

    schema = "cluster long, row long, sums array<double>"
    return big.select("cluster", "x", "r").mapInArrow(run, schema).groupBy("cluster", "row").applyInArrow(added, schema)


def cluster_models(routed: Stage, kernel, dim: int, outputs: int, reg: float, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centres and coefficients of a regression of r on x for each cluster of a written
    table (cluster, x, r, h)."""
    sizes = routed.rows.groupBy("cluster").agg(F.count("*").alias("n"))
    if sum(min(r["n"], most) for r in sizes.collect()) > ALL_CENTRES:  # a row a cluster
        raise ValueError(f"more than {ALL_CENTRES} fine centres: take fewer for each cluster")
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def whole(table: pa.Table) -> pa.Table:
        x, r = gram.rows_of(table.column("x").combine_chunks()), gram.rows_of(table.column("r").combine_chunks())
        order = np.lexsort(x.T[::-1])
        theta = linalg.solve_spd(kernel(x[order], x[order]), r[order], reg)
        return pa.table({"cluster": table.column("cluster").slice(0, 1), "x": [x[order].ravel().tolist()], "theta": [theta.ravel().tolist()]})

    small = routed.rows.join(F.broadcast(sizes.where(F.col("n") <= most).select("cluster")), "cluster")
    for m in small.select("cluster", "x", "r").groupBy("cluster").applyInArrow(whole, "cluster long, x array<double>, theta array<double>").collect():
        kept[m["cluster"]] = np.array(m["x"]).reshape(-1, dim), np.array(m["theta"]).reshape(-1, outputs)

    large = sizes.where(F.col("n") > most)
    fine: dict[int, np.ndarray] = {}
    for m in least_hashes(routed.rows, large, most).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("ys")).collect():
        fine[m["cluster"]] = np.array([y["x"] for y in m["ys"]])
    if fine:

        def solved(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("row").to_numpy())
            m = gram.rows_of(table.column("sums").combine_chunks())[order]
            return pa.table({"cluster": table.column("cluster").slice(0, 1), "theta": [linalg.solve_spd(m[:, : len(m)], m[:, len(m) :], reg).ravel().tolist()]})

        big = routed.rows.join(F.broadcast(large.select("cluster")), "cluster")
        for m in _parts(big, fine, kernel, outputs).groupBy("cluster").applyInArrow(solved, "cluster long, theta array<double>").collect():
            kept[m["cluster"]] = fine[m["cluster"]], np.array(m["theta"]).reshape(-1, outputs)
    return kept


def fit(df: DataFrame, values: list[str], spec: KernelSpec, centres: Centres, most: int) -> Callable[[DataFrame], DataFrame]:
    """A function z -> (id, f) of the two-scale model of df (id, x, values)."""
    coarse = model.fit(df, values, spec, centres)
    kernel = lambda a, b: kernels.block(spec, coarse.chain.apply(a), coarse.chain.apply(b))
    routed = Stage(_routed(df, values, coarse, centres), "routed")
    kept = cluster_models(routed, kernel, coarse.dim, len(values), spec.reg, most)
    routed.drop()

    def predict(z: DataFrame) -> DataFrame:
        kind = z.schema["id"].dataType.simpleString()

        def block(ids, m):
            f = coarse.values(m)
            at = kernels.sq_dist(m, centres.x).argmin(1)
            for c in np.unique(at):
                if c in kept:
                    y, theta = kept[c]
                    f[at == c] += kernel(m[at == c], y) @ theta
            return {"id": ids[0], "f": gram._lists(f)}

        return gram.by_block(z, block, f"id {kind}, f array<double>", max(len(centres), most))

    return predict
