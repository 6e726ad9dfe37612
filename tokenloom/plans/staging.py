"""Intermediate tables in the folder all executors share.

A staged table cuts lineage and survives the loss of any executor.  Unlike
``DataFrame.checkpoint`` it is columnar, so readers still prune columns.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a folder of its
    own, since all its tasks run on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tokenloom-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path that nothing else uses, in this application's part of the shared
    folder, which can be removed as a whole once the application has ended."""
    application = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{application}/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, what was staged meanwhile; for runs that write their
    results out before they return."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(hadoop, True)


def discard(staged: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    for folder in {name.rpartition("/")[0] for name in staged.inputFiles()}:
        _delete(staged.sparkSession, folder)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, label)
    # Not lz4_raw: pages are written that the reader refuses ("all input must be consumed").
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files that no DataFrame needs any more.

    It does so when the driver collects its garbage, which a large heap may put off until the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
