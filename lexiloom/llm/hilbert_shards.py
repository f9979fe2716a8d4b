"""Sharding along a Hilbert curve, law ``rows``: shard counts differ by one at most.

Each row's metadata (language, source and size) is quantised to a cell of a grid, every dimension by how its values are spread
over all rows; the rows are range-sorted by the cell's place on the Hilbert curve, then by the text's checksum, and the sorted
run is cut into shards of equal row counts, so that files cover small boxes of all dimensions at once and a filter on any of
them prunes.  Copies of one text with one language
and source lie together; where their run crosses a border it is cut, since no law could hold a group of a third of all rows
whole.

Results for odd input: a null text has size 1 and checksum 0; null dimensions, and those that the table has no column
for, are quantised to 0; repeated rows get slots of their own; an empty table gives no rows; more shards than rows leave
shards empty; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, table
from lexiloom.operators.ordering import running_sum

BITS = 8
#: Bytes of a dimension's distinct values up to which their cells are broadcast; more are joined by a shuffle, with the same result.
SHARED_BYTES = 16 << 20


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each point (rows of ``axes``: unsigned, under 2**bits), by Gray-code transposition."""
    x = axes.astype(np.uint64).T.copy()
    dims = len(x)
    bit = np.uint64(1) << np.uint64(bits - 1)
    while bit > 1:
        low = bit - np.uint64(1)
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = np.uint64(1) << np.uint64(bits - 1)
    while bit > 1:
        turn = np.where((x[dims - 1] & bit) != 0, turn ^ (bit - np.uint64(1)), turn)
        bit >>= np.uint64(1)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << np.uint64(1) | (x[i] >> np.uint64(b) & np.uint64(1))
    return out.astype(np.int64)


def curve(dimensions: list[Column], bits: int = BITS) -> Column:
    """The curve index of quantised dimensions (whole numbers; clipped to the grid, null: 0)."""
    top = (1 << bits) - 1

    @F.pandas_udf("long")
    def index(*axes: pd.Series) -> pd.Series:
        grid = np.stack([np.clip(a.to_numpy(), 0, top) for a in axes], axis=1)
        return pd.Series(hilbert_index(grid, bits))

    return index(*[F.coalesce(d.cast("long"), F.lit(0)) for d in dimensions])


def categories(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Every value of ``column`` and its cell: where the middle of the value's rows lies in the order of all rows.

    Rows are counted by value first; the counts are summed up by ranges of values, so no task or driver holds all values.
    """
    counts = materialise(rows.where(F.col(column).isNotNull()).groupBy(column).count(), f"hilbert-{column}")
    total, size = counts.agg(F.sum("count"), F.sum(F.octet_length(column) + 16)).first()
    upto = running_sum(counts, [column], F.col("count"), "upto")
    middle = (F.col("upto") - F.col("count") + F.col("count") / 2) / F.lit(total or 1) * (1 << bits)
    cells = upto.select(column, middle.cast("int").alias(f"{column}_cell"))
    return F.broadcast(cells) if (size or 0) <= SHARED_BYTES else cells


def size_cuts(rows: DataFrame, bits: int = BITS) -> list[int]:
    """The sizes that cut all rows into 2**bits parts of about equal counts."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    return rows.agg(F.percentile_approx("size", shares, 10_000)).first()[0] or []


def quantised(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows (lang, source, size, ...) with the cells lang_cell, source_cell and size_cell; nulls have cell 0."""
    out = rows
    for column in ("lang", "source"):
        out = out.join(categories(rows, column, bits), column, "left").fillna(0, [f"{column}_cell"])
    return out.withColumn("size_cell", F.size(F.filter(F.lit(size_cuts(rows, bits)).cast("array<long>"), lambda c: c <= F.col("size"))))


def assign(df: DataFrame, shards: int, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row."""
    known = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    sized = df.select(
        "doc_id",
        *known,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # the tie tells repeated rows apart, so that no run of equals lands in one range; written, since it must stay as it is
    sized = materialise(sized.withColumn("tie", F.monotonically_increasing_id()), "hilbert-sizes")
    placed = quantised(sized, bits)
    placed = placed.withColumn("curve", curve([F.col("lang_cell"), F.col("source_cell"), F.col("size_cell")], bits))
    placed = placed.select("doc_id", "size", "text_crc32", "curve", "tie")
    keys = ["curve", "text_crc32", "doc_id", "tie"]
    run = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    run = run.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    run = materialise(run, "hilbert")
    # one number a partition: bounded by the number of partitions
    counts = sorted((r["part"], r["count"]) for r in run.groupBy("part").count().collect())
    total, begin = 0, []
    for part, n in counts:
        begin.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(begin, "part int, begin long")
    at = run.join(F.broadcast(starts), "part").withColumn("at", F.col("begin") + F.col("at"))
    shard = F.floor(F.col("at") * shards / max(total, 1)) if total * shards < 2**52 else F.expr(f"at * {shards} div {total}")
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("at") - first).select(
        "doc_id", "size", "text_crc32", "curve", "shard", "slot"
    )


def write_shards(df: DataFrame, assigned: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write ``df`` (unique doc_id, no columns run, shard, slot or curve) by shard, a file for each run of the curve, whose footer
    prunes by every dimension."""
    run = F.expr(f"slot div {rows_per_file}")
    kept = df.join(assigned.select("doc_id", "curve", "shard", "slot"), "doc_id").withColumn("run", run)
    kept.repartition("shard", "run").sortWithinPartitions("shard", "run", "slot").write.partitionBy("shard", "run").parquet(path)


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


QUERIES = {"op7_hilbert_sharding": op7_hilbert_sharding}
ORACLES: dict[str, str] = {}
