"""Type coercion: what becomes a number, a date, an array or a map, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordinal of 1970-01-01 in the proleptic Gregorian calendar.
EPOCH_ORDINAL = 719163


def date_ordinal(d: Column) -> Column:
    """Days since 0001-01-01, that day being 1."""
    return (F.unix_date(d.cast("date")) + EPOCH_ORDINAL).cast("double")


def timestamp_seconds(t: Column) -> Column:
    """Seconds since 1970-01-01 of the clock time, whatever the session's zone."""
    return F.unix_date(t.cast("date")) * 86400.0 + F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t).cast("double")


def interval_days(seconds: Column) -> Column:
    return seconds.cast("double") / 86400


def float_nan(c: Column, nan_value: float = float("nan")) -> Column:
    """A number, or nan_value where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(nan_value))


def date_of(c: Column, pattern: str = "dd/MM/yyyy") -> Column:
    """Date of a string by pattern; null if it does not match."""
    return F.try_to_timestamp(c, F.lit(pattern)).cast("date")


def date_of_ordinal(n: Column) -> Column:
    return F.date_from_unix_date((n - EPOCH_ORDINAL).cast("int"))


def comma_date(c: Column, pattern: str = "dd.MM.yyyy") -> Column:
    """Strings with commas for dots, read as dates, as ordinal days."""
    return date_ordinal(F.try_to_timestamp(F.replace(c, F.lit(","), F.lit(".")), F.lit(pattern)))


def matrix(df: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """The canonical point frame (id, x array<double>) of numeric columns."""
    return df.select(F.col(id_column).alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))


def cells(df: DataFrame) -> int:
    """Number of cells, which is what length means for a frame."""
    return df.count() * len(df.columns)


def multimap(df: DataFrame, array: str) -> DataFrame:
    """An array as (k, v) rows: place -> element."""
    return df.select(F.posexplode(array).alias("k", "v"))


def map_rows(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("k", "v"))


def values_in_key_order(df: DataFrame, k: str, v: str) -> DataFrame:
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda s: s[v]).alias("values"))


def slice_of(a: Column, index: int) -> Column:
    """Element along one dimension of a nested array."""
    return F.get(a, F.lit(index))
