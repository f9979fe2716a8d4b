"""Line files and files of blocks that blank lines end, read by many tasks a file.

Spark's text scan deals a file into splits at line ends, and each row knows its split.  What crosses a split is settled afterwards
from a few small rows a split: the pieces of a block that begins in one split and ends in a later one are put together, and line
numbers start at the lines of all earlier splits.  A line is held whole, and so is a block; nothing else is.  Files can lie in
any store that Spark reads.

Results for odd input: blanks at a line's end are no part of it, and a line of blanks is a blank one; lines end with LF, CR LF or CR; what
follows the last blank line of a file is no block; empty files and missing lines give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.tables import materialise

#: What a row of ``_cut`` is: a block; the end of one that began in an earlier split; the begin of one; a split without a blank line.
WHOLE, END, BEGIN, MIDDLE = range(4)


def split_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, split (where it begins in the file) and value of every line, in the file's order within a task."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, split, first row, row after the last) of a batch's stretches of one split."""
    files, splits = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    cuts = np.flatnonzero(np.diff(splits) | np.diff(files.indices.to_numpy())) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
        if b > a:
            yield files[a].as_py(), int(splits[a]), a, b


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map (file, split, value) to (file, split, nth, role, value): blocks, and pieces of those that cross a split."""
    key: tuple | None = None
    held: list[str] = []
    nth, seen = 0, False
    out: list[tuple] = []

    def put(role: int) -> None:
        nonlocal nth
        out.append((*key, nth, role, "\n".join(held)))
        held.clear()
        nth += 1

    def finish() -> None:
        if key is not None and (held or not seen):
            put(BEGIN if seen or key[1] == 0 else MIDDLE)

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "split", "nth", "role", "value"])

    for batch in batches:
        lines = pc.utf8_rtrim_whitespace(batch.column(2)).to_pylist()
        for file, split, a, b in _runs(batch):
            if (file, split) != key:
                finish()
                key, nth, seen = (file, split), 0, False
            for line in lines[a:b]:
                if line:
                    held.append(line)
                elif not seen and split:  # closes what an earlier split has begun, if it has
                    seen = True
                    put(END)
                else:
                    seen = True
                    if held:
                        put(WHOLE)
        yield rows()
    finish()
    yield rows()


def file_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, split, nth (together ascending within a file) and value (lines joined by line feeds) of each block of the files."""
    cut = materialise(split_lines(spark, path).mapInArrow(_cut, "file string, split long, nth long, role int, value string"), "file-blocks")
    place = Window.partitionBy("file").orderBy("split", "role")  # two rows a split at most
    closed = F.sum((F.col("role") == END).cast("int")).over(place.rowsBetween(Window.unboundedPreceding, -1))
    pieces = cut.where(F.col("role") != WHOLE).withColumn("block", F.coalesce(closed, F.lit(0)))
    piece = F.struct("split", "role", "nth", "value")
    joined = pieces.groupBy("file", "block").agg(F.array_sort(F.collect_list(piece)).alias("x")).where(F.exists("x", lambda p: p["role"] == END))
    texts = F.transform(F.filter("x", lambda p: p["value"] != ""), lambda p: p["value"])
    first = F.element_at("x", 1)
    crossing = joined.select("file", first["split"].alias("split"), first["nth"].alias("nth"), F.array_join(texts, "\n").alias("value")).where("value <> ''")
    return cut.where(F.col("role") == WHOLE).drop("role").unionByName(crossing)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map (file, split, value) to the same and the line's number within its split."""
    key, n = None, 0
    for batch in batches:
        numbers = []
        for file, split, a, b in _runs(batch):
            if (file, split) != key:
                key, n = (file, split), 0
            numbers.append(np.arange(n, n + b - a))
            n += b - a
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *numbers]))], ["file", "split", "value", "nth"])


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no (from 0 within a file) and value of every line that is not empty."""
    lines = split_lines(spark, path)
    sizes = materialise(lines.groupBy("file", "split").agg(F.count("*").alias("n")), "split-sizes")  # a row a split
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = lines.mapInArrow(_count, "file string, split long, value string, nth long").join(starts, ["file", "split"])
    return numbered.select("file", (F.col("before") + F.col("nth")).alias("line_no"), "value").where("value <> ''")
