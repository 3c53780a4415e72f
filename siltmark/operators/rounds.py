"""Results of a round that the next one starts from, kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one if driver and executors are one process (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltmark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def settled(df: DataFrame, *earlier: DataFrame) -> DataFrame:
    """df as a table of its own: its lineage ends there, so a lost executor costs no recomputation. Earlier ones that it was made of are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_in = path
    release(*earlier)
    return out


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run meanwhile go when they have ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def release(*tables: DataFrame) -> None:
    """Removes tables of settled() that nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "settled_in", None)
        if path in _MADE:
            _remove(_MADE.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _end() -> None:
    for path, spark in _MADE.items():
        try:
            _remove(spark, path)
        except Exception:  # the session has ended before
            return


atexit.register(_end)
