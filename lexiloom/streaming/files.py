"""The annotation plan over a stream of files: each micro-batch runs the batch plan, so results are the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def annotate_stream(
    spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 64
) -> StreamingQuery:
    """Run ``plan`` on new Parquet files of ``source`` and write to ``sink``; ends when all present files are done.

    A micro-batch overwrites the folder of its number, so a repeated one leaves no double rows.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
