"""Ordered operators: ranks, returns, replay buffers, remaps and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def global_rank(df: DataFrame, columns: list, out: str = "rank", parts: int | None = None) -> DataFrame:
    """Rank from 1 in a total order without sorting in one task: rows are split by
    range, ranked within a range, and offset by the counts of the ranges before."""
    spark = df.sparkSession
    n = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = columns[0] if isinstance(columns[0], str) else None
    if first is None:
        raise ValueError("the first key must be a column name")
    cuts = df.select(F.percentile_approx(F.col(first).cast("double"), [k / n for k in range(1, n)], 1000)).head()[0] or []
    bucket = F.lit(0)
    for c in sorted(set(cuts)):
        bucket = bucket + (F.col(first).cast("double") > c).cast("int")
    tagged = df.withColumn("__bucket", F.coalesce(bucket, F.lit(-1)))
    sums = tagged.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sums.select(F.col("__bucket").alias("__b"), (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*columns))
    return tagged.join(F.broadcast(before), F.col("__bucket") == F.col("__b")).withColumn(out, within + F.col("__before")).drop("__bucket", "__b", "__before")


def lexicographical_permutation(df: DataFrame, key: str, id_column: str, out: str = "position") -> DataFrame:
    """Rows with their place (from 0) when sorted by one key; ties by id."""
    return global_rank(df, [key, id_column], "__r").withColumn(out, F.col("__r") - 1).drop("__r")


def discounted_returns(df: DataFrame, game: str, reward: str, latest_first: list[Column], gamma: float, out: str = "ret", ranges: int | None = None) -> DataFrame:
    """G_t = R_t + gamma G_{t+1} over each game, latest row first: a parallel scan, so a
    game of any length is spread over tasks. A null reward counts as 0."""
    return scan.recurrence(df, game, reward, latest_first, gamma, out, ranges)


class ReplayBuffer:
    """A bounded log of games as a table (game, t, ...): push appends, trims keep the
    newest rows or drop the worst games. A value: every change gives a new buffer."""

    def __init__(self, rows: DataFrame | None = None, game: str = "game", t: str = "t", reward: str = "reward", capacity: int | None = None):
        self.rows, self.game, self.t, self.reward, self.capacity = rows, game, t, reward, capacity

    def _with(self, rows: DataFrame) -> "ReplayBuffer":
        return ReplayBuffer(rows, self.game, self.t, self.reward, self.capacity)

    def __len__(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def is_full(self) -> bool:
        return self.capacity is not None and len(self) >= self.capacity

    def push(self, rows: DataFrame, worst_game: bool = False) -> "ReplayBuffer":
        grown = self._with(rows if self.rows is None else self.rows.unionByName(rows))
        return grown.trim(worst_game) if self.capacity is not None else grown

    def trim(self, worst_game: bool = False) -> "ReplayBuffer":
        return self._with(keep_best_games(self.rows, self.game, self.reward, self.capacity) if worst_game else keep_last(self.rows, [F.desc(self.game), F.desc(self.t)], self.capacity))

    def empty(self, keep: int = 0) -> "ReplayBuffer":
        return self._with(keep_last(self.rows, [F.desc(self.game), F.desc(self.t)], keep))

    def sample(self, n: int, seed: int = 42) -> DataFrame:
        """n rows without replacement (all, if fewer): the least of a seeded hash."""
        return self.rows.orderBy(F.xxhash64(F.lit(seed), self.game, self.t), self.game, self.t).limit(n)

    def games(self) -> DataFrame:
        return self.rows.select(self.game).distinct()

    def remove_games(self, gone: DataFrame) -> "ReplayBuffer":
        return self._with(self.rows.join(gone, self.game, "left_anti"))

    def last_game(self) -> DataFrame:
        top = self.rows.agg(F.max(self.game).alias("__top"))
        return self.rows.join(F.broadcast(top), F.col(self.game) == F.col("__top")).drop("__top")

    last = last_game

    def __getitem__(self, ids: DataFrame) -> DataFrame:
        """Rows of given (game, t)."""
        return self.rows.join(ids, [self.game, self.t], "left_semi")


def keep_last(rows: DataFrame, latest_first: list[Column], n: int, by: str | None = None) -> DataFrame:
    """The last n rows (of each by): a top-n, which Spark takes per partition first."""
    if by is None:
        return rows.orderBy(*latest_first).limit(n)
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*latest_first))).where(F.col("__rn") <= n).drop("__rn")


def game_scores(rows: DataFrame, game: str, reward: str) -> DataFrame:
    """(game, n, score): sum minus population variance of rewards."""
    return rows.groupBy(game).agg(F.count("*").alias("n"), (F.sum(reward) - F.var_pop(reward)).alias("score"))


def keep_best_games(rows: DataFrame, game: str, reward: str, capacity: int) -> DataFrame:
    """Whole games, best first, while they fit the capacity."""
    scores = game_scores(rows, game, reward)
    fits = F.sum("n").over(Window.orderBy(F.desc("score"), game)) <= capacity
    return rows.join(scores.withColumn("__fits", fits).where("__fits").select(game), game, "left_semi")


def remap(df: DataFrame, column: str, mapping: DataFrame, k: str, v: str, missing=0, out: str = "mapped") -> DataFrame:
    """Each value through a dictionary table, missing keys to a default."""
    return df.join(mapping.select(F.col(k).alias("__k"), F.col(v).alias("__v")), F.col(column) == F.col("__k"), "left").withColumn(out, F.coalesce("__v", F.lit(missing))).drop("__k", "__v")


def inverted(df: DataFrame, k: str, v: str) -> DataFrame:
    """value -> sorted list of its distinct keys."""
    return df.groupBy(v).agg(F.sort_array(F.collect_set(k)).alias("keys"))


def most_frequent(df: DataFrame, key: str, value: str, out: str = "mode") -> DataFrame:
    """Most frequent value of each key, the least one on ties; counts are pre-aggregated."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("__c"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("__c"), F.col(value))).alias(out))


def grouped_lists(df: DataFrame, key: str, value: str, out: str = "values") -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(out))


def closest(df: DataFrame, column: str, grid: list[float]) -> DataFrame:
    """closest_index (bisect left, at most the last) and closest_value (the lower on ties)
    of a short sorted list: binary-search-free comparisons on a literal array."""
    g = F.array(*(F.lit(float(v)) for v in grid))
    q = F.col(column).cast("double")
    at = F.least(F.size(F.filter(g, lambda v: v < q)), F.lit(len(grid) - 1))
    low, high = F.get(g, F.greatest(at - 1, F.lit(0))), F.get(g, at)
    return df.withColumns({"closest_index": at.cast("int"), "closest_value": F.when(q - low <= high - q, low).otherwise(high)})


def asof_closest(left: DataFrame, right: DataFrame, on: str, value: str) -> DataFrame:
    """Nearest right row for each left row on a number, for lists of any length: both
    sides are merged in one order and the neighbours on either side compared; the
    lower wins ties. Buckets between quantiles keep the order out of one task, however the
    values lie."""
    both = left.select("*", F.col(on).cast("double").alias("__q"), F.lit(None).cast("double").alias("__v")).unionByName(right.select(F.col(value).cast("double").alias("__q"), F.col(value).cast("double").alias("__v")).distinct(), allowMissingColumns=True)
    n = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = both.select(F.percentile_approx("__q", [k / n for k in range(1, n)], 1000)).head()[0] or []
    b = sum(((F.col("__q") > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    tagged = both.withColumn("__b", b)
    edges = tagged.groupBy("__b").agg(F.max("__v").alias("__top"), F.min("__v").alias("__bottom"))
    order = Window.orderBy("__b")
    edges = edges.select(F.col("__b").alias("__eb"), F.last("__top", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__below"), F.first("__bottom", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__above"))
    w = Window.partitionBy("__b").orderBy("__q", F.col("__v").isNull())
    low = F.last("__v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("__v", True).over(Window.partitionBy("__b").orderBy("__q", F.col("__v").isNotNull()).rowsBetween(0, Window.unboundedFollowing))
    found = tagged.join(F.broadcast(edges), F.col("__b") == F.col("__eb")).withColumns({"__low": low, "__high": high})
    found = found.where(F.col("__v").isNull()).withColumns({"__low": F.coalesce("__low", "__below"), "__high": F.coalesce("__high", "__above")})
    pick = F.when(F.col("__high").isNull() | (F.col("__q") - F.col("__low") <= F.col("__high") - F.col("__q")), F.col("__low")).otherwise(F.col("__high"))
    return found.withColumn("closest_value", pick).select(*left.columns, "closest_value")


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order (a top-n report)."""
    return df.orderBy(*order).limit(n)


