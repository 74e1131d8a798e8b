"""Helpers shared by the training-data operators.

Words everywhere are runs of ``[^\\x20\\x09-\\x0D]``; ``bytes.split()`` splits on
exactly those six bytes, so texts cross to Python as UTF-8 binary.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session that has none, on one machine (tests, local mode), gets one of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gramlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and return the written table: lineage ends here,
    and a lost executor costs no more than a reread.

    narrow: rows of a few numbers, written by two tasks a core at most, so that small
    tables do not become as many files as a shuffle has partitions.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def removed(spark: SparkSession, *urls: str) -> None:
    """Delete files and folders."""
    for url in urls:
        path = spark._jvm.org.apache.hadoop.fs.Path(url)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of staged() that no later step reads."""
    for df in tables:
        removed(df.sparkSession, df._staged_path)


def write_file(url: str, content: bytes) -> None:
    """A file of the shared folder, whole or not at all; a second run writes it anew."""
    store, path = fs.FileSystem.from_uri(url)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(content)
    store.move(part, path)


def read_file(url: str) -> pa.Buffer:
    """A file of the shared folder: memory-mapped on a mounted file system, else read."""
    store, path = fs.FileSystem.from_uri(url)
    f = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    return f.read_buffer()


def binary(column) -> "F.Column":
    """UTF-8 bytes of a string column, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def crc_fold(id_column: str, modulus: int):
    """crc32 of the id written as text, modulo modulus."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (wrapping arithmetic)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def total_parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle of blobs: what the session asks for, two per core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
