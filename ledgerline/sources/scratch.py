"""The folder that driver and executors share, for tables that jobs pass on to one another."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_root: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, one of our own if driver and executors
    are one process; else there is no folder that all of them see, which is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="ledgerline-")
    return f"file://{_own_root[app]}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own below the shared folder; what is there goes when the application ends."""
    path = f"{shared_root(spark)}/ledgerline/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop_at_exit, spark, path)
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is made here, for tables that are written out before the end of the block, goes with it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_table(spark, path)


def file_system(spark: SparkSession, path: str):
    """The store that a path is in, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop_table(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def folders(spark: SparkSession, path: str, finished: bool = False) -> list[str]:
    """Names of the folders in a folder; with ``finished`` those only that a write has completed."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n in names if not finished or fs.exists(done(f"{path}/{n}/_SUCCESS")))


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_table(spark, path)


def materialise(df: DataFrame, tag: str, path: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs start from files that outlive
    executors, not from a long lineage. Returns the table and its path (for drop_table)."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
