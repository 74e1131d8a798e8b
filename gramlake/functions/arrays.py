"""Array, probability and encoding expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def let(value: Column, f) -> Column:
    """f of a value that is computed once: inside a lambda it is a bound variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def probas_projection(a: Column) -> Column:
    """Normalised to sum one."""
    return let(a, lambda x: let(total(x), lambda t: F.transform(x, lambda v: v / t)))


def softmax(a: Column) -> Column:
    return let(a, lambda x: let(F.array_max(x), lambda m: probas_projection(F.transform(x, lambda v: F.exp(v - m)))))


def verhulst(probs: Column, advantages: Column) -> Column:
    """Replicator step: softmax(log p + advantage)."""
    return softmax(F.zip_with(probs, advantages, lambda p, a: F.log(p) + a))


def tensor_probas(p: Column) -> Column:
    """Jacobian of softmax: p_j (delta_jk - p_k)."""
    return let(p, lambda x: F.transform(x, lambda pj, j: F.transform(x, lambda pk, k: pj * (F.when(j == k, 1.0).otherwise(0.0) - pk))))


def argmax(a: Column) -> Column:
    """Place of the largest element, the first on ties."""
    return let(a, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def argmin(a: Column) -> Column:
    return let(a, lambda x: (F.array_position(x, F.array_min(x)) - 1).cast("int"))


def masked(a: Column, i: Column, value: float) -> Column:
    """The array with place i (the diagonal of row i) replaced."""
    return F.transform(a, lambda v, k: F.when(k == i, F.lit(value)).otherwise(v))


def gather(a: Column, i: Column) -> Column:
    """The element at place i; null outside."""
    return F.get(a, i)


def fill(a: Column, values: Column, i: Column | None = None, op=None) -> Column:
    """Write a value at place i (everywhere if None), or op(old, value)."""
    new = (lambda v: op(v, values)) if op else (lambda v: values)
    return F.transform(a, new) if i is None else F.transform(a, lambda v, k: F.when(k == i, new(v)).otherwise(v))


def pad(a: Column, n: Column | int) -> Column:
    """Zeros appended up to length n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def clamp(x: Column, low: Column, high: Column) -> Column:
    """Each coordinate into [low, high]."""
    return F.transform(F.arrays_zip(x.alias("x"), low.alias("l"), high.alias("h")), lambda t: F.greatest(F.least(t["x"], t["h"]), t["l"]))


def one_hot(label: Column, n: int) -> Column:
    """Dense one-hot of an integer label."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def unity_partition(value: Column, values: list) -> Column:
    """One-hot against given (or sorted distinct) values."""
    return F.array(*(F.when(value.eqNullSafe(F.lit(v)), 1.0).otherwise(0.0) for v in values))


def format_32(df: DataFrame, ids: str, a: str) -> DataFrame:
    """(A, B, C) -> (A C, B): rows (id, c, array over b) from an array<array<double>>."""
    width = F.size(F.element_at(F.col(a), 1))
    return df.select(ids, F.explode(F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.struct(c.cast("int").alias("c"), F.transform(F.col(a), lambda row: F.get(row, c)).alias("row")))).alias("s")).select(ids, "s.c", "s.row")


def format_23(df: DataFrame, ids: str) -> DataFrame:
    """The inverse of format_32."""
    rows = df.groupBy(ids).agg(F.sort_array(F.collect_list(F.struct("c", "row"))).alias("s"))
    width = F.size(F.element_at(F.col("s"), 1)["row"])
    return rows.select(ids, F.transform(F.sequence(F.lit(0), width - 1), lambda b: F.transform(F.col("s"), lambda t: F.get(t["row"], b))).alias("a"))
