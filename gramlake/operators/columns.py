"""Projection, column selection, boxes and feature selection."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def starting_cols(names: list[str], prefixes) -> list[str]:
    prefixes = (prefixes,) if isinstance(prefixes, str) else tuple(prefixes)
    return [n for n in names if n.startswith(prefixes)]


def matching_cols(names: list[str], words) -> list[str]:
    """Names that contain each word in turn; a name may come more than once."""
    return [n for w in ((words,) if isinstance(words, str) else words) for n in names if w in n]


def cols_with_words(names: list[str], words) -> list[str]:
    return [n for n in names if any(w in n for w in words)]


def column_selector(df: DataFrame, keep=(), drop=(), split: bool = False):
    """Drop, then keep columns by name prefix; with split, also what was left out."""
    names = df.columns
    left = [n for n in names if n not in starting_cols(names, drop)] if drop else names
    kept = starting_cols(left, keep) if keep else left
    chosen = df.select(*kept)
    return (chosen, df.select(*(n for n in names if n not in kept))) if split else chosen


def constant_columns(df: DataFrame) -> DataFrame:
    """(column): those with one distinct value, null counting as a value. One pass of
    mergeable aggregates."""
    names = df.columns
    stats = df.agg(*(F.struct((F.min(c).eqNullSafe(F.max(c)) & (F.max(F.col(c).isNull()) == F.min(F.col(c).isNull()))).alias("k"), F.lit(c).alias("column")).alias(f"s{i}") for i, c in enumerate(names)))
    return stats.select(F.explode(F.array(*(f"s{i}" for i in range(len(names))))).alias("s")).where("s.k").select("s.column")


def null_rows(df: DataFrame) -> DataFrame:
    return df.where(reduce(or_, (F.col(c).isNull() for c in df.columns)))


def bound_box(df: DataFrame, *columns: str, coeff: float | None = None) -> DataFrame:
    """(dim, low, high) of each column; coeff scales the box about its middle."""
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("l", F.min), ("h", F.max))))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dim"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, c in enumerate(columns)))).alias("s")).select("s.*")
    if coeff is None:
        return rows
    mid = (F.col("low") + F.col("high")) / 2
    return rows.select("dim", (mid + (F.col("low") - mid) * coeff).alias("low"), (mid + (F.col("high") - mid) * coeff).alias("high"))


def clamp_to(df: DataFrame, box: DataFrame) -> DataFrame:
    """Columns of df clamped to a box of bound_box(): a few numbers, one row a column."""
    limits = {r["dim"]: (r["low"], r["high"]) for r in box.collect()}
    return df.withColumns({c: F.greatest(F.least(F.col(c).cast("double"), F.lit(h)), F.lit(l)) for c, (l, h) in limits.items()})


def variable_selector(df: DataFrame, target: str, score: Callable[[DataFrame, list[str]], float], keep=(), drop=(), last=()) -> list[tuple[str, float]]:
    """Greedy forward selection: score every candidate with the kept columns, then add
    them in that order, each only if the error falls strictly. A score that fails
    counts as infinite. Constant columns are never candidates."""
    constant = {r[0] for r in constant_columns(df).collect()}
    free = [c for c in df.columns if c not in {target, *keep, *drop, *last} and c not in constant]

    def error(cols: list[str]) -> float:
        try:
            return float(score(df, cols))
        except Exception:
            return float("inf")

    ranked = sorted(((error([*keep, c]), k, c) for k, c in enumerate(free)))
    order = [c for *_, c in ranked] + [c for c in last if c not in constant]
    chosen, best, out = [*keep], error([*keep]) if keep else float("inf"), []
    for c in order:
        e = error([*chosen, c])
        if e < best:
            chosen.append(c)
            best = e
            out.append((c, e))
    return out
