"""Tables in the folder that the driver and all executors share: lineage is cut there, so lost executors cost no recomputation."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no spark.checkpoint.dir, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/lexiloom"
#: A table of fewer bytes for each core than this is dealt out anew before costly maps, since it may lie in one row group.
SMALL_BYTES = 4 << 20

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.  On a cluster it has to be set: a local folder would lose rows."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or LOCAL_DIR


def _delete(spark: SparkSession, path: str, at_exit: bool) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if at_exit:
        files.deleteOnExit(jvm_path)
    else:
        files.delete(jvm_path, True)


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    _delete(spark, path, at_exit=True)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Survives lost executors, stays compressed and keeps column pruning for later readers.  The table goes with ``discard``, or when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for made in _scopes:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            _delete(df.sparkSession, path, at_exit=False)


@contextmanager
def temporary(*kept: str) -> Iterator[None]:
    """Tables that are materialised inside go at the end, but for those of the names ``kept``: what a finished step no longer needs."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        discard(*[df for df in made if _paths.get(df, "").rpartition("/")[2].rpartition("-")[0] not in kept])


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is small; large tables are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES * cores else df
