"""Work folders on storage that every executor can reach.

A work folder lies under ``spark.checkpoint.dir``. Only where that setting is
missing and the session is local (tests), a temporary folder of the machine is
used; on a cluster a missing setting is an error.

Results are read from work folders when they are asked for, so these stay until the program
ends, or to the end of the innermost ``scope`` in which they were made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_base: list[str] = []
_scopes: list[list[str]] = []


def shared_base(spark: SparkSession) -> str:
    """The folder shared by all executors (the session's checkpoint folder)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    if not _local_base:
        _local_base.append(tempfile.mkdtemp(prefix="tidelog-"))
        atexit.register(shutil.rmtree, _local_base[0], True)
    return "file://" + _local_base[0]


def hadoop(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path or URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def _clean(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # the session may be gone at interpreter exit
        pass


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the work folders made inside at the end: for long sessions, around a query
    together with the writing or collecting of its result."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _clean(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder path for one run; see the module text for its end."""
    path = f"{shared_base(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    else:
        atexit.register(_clean, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a work folder and read it back: a cut of the lineage that
    survives the loss of executors, unlike cached or locally checkpointed data."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, p = hadoop(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
