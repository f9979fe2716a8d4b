"""Lines appended to a folder in batches, of which readers see each whole and once, whatever was killed or repeated.

A batch is written as an attempt of its own, whose files Spark publishes when all its tasks have ended; then one row in the table of
commits names it.  Readers take the lines of committed attempts only, and of a batch that was committed twice the first attempt.
An append of a batch that is committed already writes nothing.  Everything goes through Spark's readers and writers, so any store that
they reach will do.

Results for odd input: null values are empty lines; a value with line breaks is read back as several lines; an empty batch is
committed and has no lines; a folder that nothing was appended to has no lines.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

NAME = re.compile(r"[A-Za-z0-9_.-]+")
COMMITS = "batch string, attempt string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """batch and attempt, one row a batch."""
    path = f"{folder}/commits"
    rows = spark.read.schema(COMMITS).json(path) if _exists(spark, path) else spark.createDataFrame([], COMMITS)
    return rows.groupBy("batch").agg(F.min("attempt").alias("attempt"))


def _write(lines: DataFrame, folder: str, batch: str) -> str:
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    lines.select("value").write.text(f"{folder}/lines/batch={batch}/attempt={attempt}")
    return attempt


def _commit(spark: SparkSession, folder: str, batch: str, attempt: str) -> None:
    spark.createDataFrame([(batch, attempt)], COMMITS).coalesce(1).write.mode("append").json(f"{folder}/commits")


def append(lines: DataFrame, folder: str, batch: str) -> bool:
    """Append the column ``value`` as the batch of that name; false if it was there before."""
    if not NAME.fullmatch(batch):
        raise ValueError(f"a batch's name has letters, digits, hyphens, dots and underscores only: {batch!r}")
    spark = lines.sparkSession
    if not commits(spark, folder).where(F.col("batch") == batch).isEmpty():
        return False
    _commit(spark, folder, batch, _write(lines, folder, batch))
    return True


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """batch and value of all lines that are committed; files of other attempts are pruned by their folders' names."""
    path = f"{folder}/lines"
    if not _exists(spark, path):
        return spark.createDataFrame([], "batch string, value string")
    rows = spark.read.schema("value string, batch string, attempt string").option("basePath", path).text(path)
    return rows.join(commits(spark, folder), ["batch", "attempt"], "left_semi").select("batch", "value")


def append_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream (value) brings, a batch for each micro-batch; ends when all present data are done."""
    out = stream.writeStream.foreachBatch(lambda rows, number: append(rows, folder, str(number)) and None)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
