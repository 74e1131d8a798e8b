"""User functions: per-row functions of arrays, parameter sweeps, timing, confusion counts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gram


def vectorized(df: DataFrame, fun: Callable[[np.ndarray], np.ndarray], out: str = "y") -> DataFrame:
    """(id, out array): a vector -> vector function on every row, an Arrow block at a time."""
    kind = df.schema["id"].dataType.simpleString()
    return gram.by_block(df, lambda ids, m: {"id": ids[0], out: gram._lists(np.array([np.ravel(fun(r)) for r in m]).reshape(len(m), -1))}, f"id {kind}, {out} array<double>", 64)


def scalar(df: DataFrame, fun: Callable[[np.ndarray], float], out: str = "y") -> DataFrame:
    """(id, out): a vector -> number function on every row."""
    return vectorized(df, lambda r: np.array([fun(r)]), "__y").select("id", F.get("__y", F.lit(0)).alias(out))


def parallel_task(spark: SparkSession, parameters: list[dict], fun: Callable[[dict], object]) -> list:
    """fun on every parameter set, one task each; results in the order given, as JSON
    values."""
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(parameters)], "k long, p string").repartition(max(1, len(parameters)), "k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "r": [json.dumps(fun(json.loads(p))) for p in b["p"]]})

    return [json.loads(r["r"]) for r in rows.mapInPandas(run, "k long, r string").orderBy("k").collect()]


def elapsed_time(fun: Callable[[], object]) -> tuple[object, float]:
    began = time.perf_counter()
    return fun(), time.perf_counter() - began


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n): counts, pre-aggregated by task."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
