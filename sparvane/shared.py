"""The session's shared folder: intermediate tables that all executors see, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names.

    Only on a local master may that setting be absent; a folder is made up then. On a cluster each executor
    would write to a disk of its own, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparvane-checkpoint")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/sparvane/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there,
    so a lost executor costs a reread of files and no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sparvane_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark wrote it to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize gave and nothing needs any more."""
    for t in tables:
        remove(t.sparkSession, t._sparvane_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Paths that shared_path gives out inside are deleted at the end: what must outlive it has to be written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)
