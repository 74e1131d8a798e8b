"""Linear recurrences along an order, as a segmented parallel scan.

g_k = r_k + gamma g_(k-1) within each group. Rows are split over tasks by ranges of (group,
order); a task scans what it has from zero. Over a stretch of n rows that brought g from
zero, the recurrence is the affine map a -> g + gamma^n a, and maps of neighbouring
stretches compose. Only the first group of a range can go on from the range before, so one
map a range, composed in order, gives what flows into each, and a narrow pass adds it with
its power of gamma. A group that holds every row is spread over all ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stage import Stage


def _local(reward: np.ndarray, new: np.ndarray, gamma: float, g: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Recurrence and rows since the start of the group, continued from (g, n)."""
    out, count = np.empty(len(reward)), np.empty(len(reward), np.int64)
    for k, (r, start) in enumerate(zip(reward.tolist(), new.tolist())):
        g, n = (r, 1) if start else (r + gamma * g, n + 1)
        out[k], count[k] = g, n
    return out, count


def inflows(summaries: list[tuple], gamma: float) -> list[float]:
    """What flows into each range, from (first group, last group, g and n of the last group
    in the range, whether the last group is the first), by order of the ranges."""
    out, carried, home = [], 0.0, None
    for first, last, g, n, one in summaries:
        out.append(carried if home is not None and home[0] == first else 0.0)
        carried = g + gamma**n * out[-1] if one else g
        home = (last,)
    return out


def recurrence(df: DataFrame, group: str, value: str, order: list[Column], gamma: float, out: str, ranges: int | None = None) -> DataFrame:
    """df with column out: the recurrence over each group in the given order. A null value
    counts as 0; null groups are one group; other columns are kept, whatever their names."""
    spark = df.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    at, by = df.columns.index(value), df.columns.index(group)
    keys = [F.col(group), *order]
    ordered = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*df.schema.fields, T.StructField("__g", T.DoubleType()), T.StructField("__n", T.LongType()), T.StructField("__range", T.IntegerType()), T.StructField("__row", T.LongType()), T.StructField("__first", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, row, home, g, n, first = TaskContext.get().partitionId(), 0, None, 0.0, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(by).to_pylist()
            new = np.array([k != before for k, before in zip(groups, [home[0] if home else object(), *groups])])
            later = np.cumsum(new) > (0 if row else 1)  # a group after the range's first
            reward = batch.column(at).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            values, counts = _local(reward, new, gamma, g, n)
            flags = ~later if first else np.zeros(len(new), bool)
            first, home, g, n = bool(flags[-1]), (groups[-1],), float(values[-1]), int(counts[-1])
            extra = [pa.array(values), pa.array(counts), pa.array(np.full(len(new), here), pa.int32()), pa.array(np.arange(row, row + len(new))), pa.array(flags)]
            row += len(new)
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    rows = Stage(ordered.mapInArrow(run, schema), "scan").rows
    last = F.max_by(F.struct(F.col(group).alias("group"), F.col("__g").alias("g"), F.col("__n").alias("n"), F.col("__first").alias("one")), "__row")
    found = rows.groupBy("__range").agg(F.min_by(F.struct(F.col(group).alias("group")), "__row").alias("a"), last.alias("z")).orderBy("__range").collect()  # a row a range
    into = inflows([(r["a"]["group"], r["z"]["group"], r["z"]["g"], r["z"]["n"], r["z"]["one"]) for r in found], gamma)
    table = spark.createDataFrame([(r["__range"], v) for r, v in zip(found, into)], "__of int, __in double")
    whole = F.when(F.col("__first"), F.col("__g") + F.pow(F.lit(float(gamma)), F.col("__n")) * F.col("__in")).otherwise(F.col("__g"))
    return rows.join(F.broadcast(table), F.col("__range") == F.col("__of")).withColumn(out, whole).select(*df.columns, out)
