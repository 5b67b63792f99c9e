"""Helpers of the training-data operators: inputs, cut lineage, skew-safe joins, file systems."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; the count is taken before each such join.
BROADCAST_ROWS = 50_000
#: Copies of the smaller side in a salted join.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only if all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tracewell-shared")
    return root.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) on the driver, for any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing exists there yet, and what comes there goes when the application ends."""
    parent = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, parent)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{parent}/data"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path made by scratch()."""
    fs, at = _hadoop(spark, path)
    fs.delete(at.getParent(), True)


class Workspace:
    """Intermediate results of one operator, each computed once and written; close() removes those not wanted any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[str, str] = {}

    def folder(self, name: str) -> str:
        self._paths[name] = scratch(self.spark, name)
        return self._paths[name]

    def put(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = self.folder(name)
        out = df.write.option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            removed(self.spark, self._paths.pop(name))

    def close(self, keep: tuple[str, ...] = ()) -> None:
        self.drop(*(set(self._paths) - set(keep)))


def release() -> None:
    """Give memory that this process has freed back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker, which waits for further tasks beside those of later stages, holds no freed memory."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and written to the shared folder; a lost executor costs no more than its own tasks."""
    return Workspace(df.sparkSession).put(df, label)


def spread_join(left: DataFrame, right: DataFrame, key: str, salt_by: str, how: str = "left") -> DataFrame:
    """left joined to right (unique by key); a key that holds many rows of left is spread over SALTS tasks.

    right is broadcast only if its counted rows are few; else it is copied once for each salt.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def filesystem(uri: str):
    """(file system, path) of a URI, for files that Spark has no writer for; works inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
