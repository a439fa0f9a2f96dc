"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on this machine alone that names no spark.checkpoint.dir, as in tests.
DEFAULT_DIR = "/tmp/checkpoints"

#: Tasks for each core of the cluster that write a small table.
FILES_A_CORE = 4

#: Paths written since the innermost ``stage_scope`` of this thread began, for each open scope: batches of a stream run beside others.
_open = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


def stage_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Without it, only a local session has one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or DEFAULT_DIR).rstrip("/")


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, which the innermost ``stage_scope`` removes at its end."""
    path = f"{stage_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1].append(path)
    return path


def staged(df: DataFrame, label: str, instead_of: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; what fails later starts from these files.

    ``instead_of`` is a staged table that only ``df`` was still made from: it is removed once ``df`` is written.
    ``few``: ``df`` is much smaller than what it is made from (counts, links), so it is written by FILES_A_CORE
    tasks a core at most, rather than as a file for each shuffle partition.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    (df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism) if few else df).write.parquet(path)
    if instead_of is not None:
        removed(spark, *{f.rsplit("/", 1)[0] for f in instead_of.inputFiles()})
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete what this module wrote; other paths are left alone."""
    jvm, conf, root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), stage_dir(spark).split(":")[-1].lstrip("/")
    for path in paths:
        if root in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are staged inside when it ends; results must be written before that."""
    _scopes().append([])
    try:
        yield
    finally:
        removed(spark, *_scopes().pop())
