"""Reading tables, writing CSV, finding files."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(df: DataFrame, id_column: str, array: str) -> DataFrame:
    """The canonical point frame (id, x array<double>)."""
    return df.select(F.col(id_column).alias("id"), F.transform(F.col(array), lambda v: v.cast("double")).alias("x"))


def save_to_file(df, path, header: bool = True, mode: str = "overwrite") -> None:
    """A frame to a CSV folder; a list of frames with a list of paths, one each."""
    if isinstance(df, (list, tuple)):
        for d, p in zip(df, path, strict=True):
            save_to_file(d, p, header, mode)
        return
    df.write.mode(mode).option("header", header).csv(path)


def files_indir(spark: SparkSession, folder: str, extension: str = ".png") -> DataFrame:
    """Files below a folder by suffix, as (path, length); contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", f"*{extension}").load(folder).select("path", "length")


def located(relative: str, kind: str = "file", roots: Iterable[str | Path] | None = None) -> str:
    """Path of the first of the roots (the interpreter's search path, if none are given)
    below which a file, or a folder, of this relative name stands. Driver side."""
    if kind not in ("file", "folder"):
        raise ValueError(f"{kind!r} is neither file nor folder")
    for root in map(Path, sys.path if roots is None else roots):
        entry = root.joinpath(relative)
        if entry.is_dir() if kind == "folder" else entry.is_file():
            return str(entry)
    raise FileNotFoundError(f"no {kind} {relative} below any root")
