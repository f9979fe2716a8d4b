"""Summaries of runs and annotations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators import scan
from lexiloom.operators.dictionaries import UNKNOWN
from lexiloom.operators.ordering import RANGE_ROWS, numbered, running_sum

#: Children of a node of the tree that sums of doubles are taken from, and leaves that one task adds up at once.
FAN, CHUNK = 16, 16**4


def health(entities: DataFrame) -> DataFrame:
    """n_types and n_resolved of each document (entities: doc_id, etype, ids)."""
    return entities.groupBy("doc_id").agg(F.countDistinct("etype").alias("n_types"), F.count_if(F.col("ids")[0] != UNKNOWN).alias("n_resolved"))


def run_stats(runs: DataFrame, value: str, by: list[str], batch: int = 1) -> DataFrame:
    """Mean, minimum and maximum a document of batches, and the population deviation, which is not divided."""
    v = F.col(value)
    return runs.groupBy(*by).agg(
        (F.avg(v) / batch).alias("mean"), F.stddev_pop(v).alias("std"), (F.min(v) / batch).alias("low"), (F.max(v) / batch).alias("high")
    )


def running_stats(runs: DataFrame, value: str, by: str, order: str, range_rows: int = scan.RANGE_ROWS) -> DataFrame:
    """Count, mean, population deviation and extremes of all runs of a key so far (see ``scan.running``)."""
    return scan.running(runs, by, order, value, range_rows).drop("place")


def error_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("error").agg(F.count("*").alias("n"))


def unknown_rate(entities: DataFrame) -> DataFrame:
    """Per cent of mentions without an id, by type (entities: etype, oid)."""
    return entities.groupBy("etype").agg((F.avg((F.col("oid") == UNKNOWN).cast("double")) * 100).alias("unknown_pct"), F.count("*").alias("n"))


def frequent_unknown(mentions: DataFrame, least: int, start: int, type_code: int, etype: str = "gene") -> DataFrame:
    """mention, n and a new uid for unresolved mentions of a type that occur ``least`` times, numbered by first place."""
    rare = mentions.where((F.col("etype") == etype) & (F.col("oid") == UNKNOWN)).groupBy("mention").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    nth = numbered(rare.where(F.col("n") >= least), ["first", "mention"], "nth")
    return nth.select("mention", "n", ((start + F.col("nth")) * 100 + type_code).cast("long").alias("uid"))


def best_ids(rows: DataFrame, type_code: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """uid of each row: the number of distinct ids so far, so an id that comes again gets the latest number."""
    first = F.row_number().over(Window.partitionBy("oid").orderBy("place")) == 1
    seen = running_sum(rows.withColumn("first", first), ["place"], F.col("first").cast("long"), "seen", range_rows)
    return seen.withColumn("uid", (F.col("seen") * 100 + type_code).cast("long")).drop("first", "seen")


def last_number(dictionary: DataFrame, uid: str = "uid") -> DataFrame:
    return dictionary.agg(F.max(F.expr(f"{uid} div 100")).alias("last_number"))


def calls(events: DataFrame, function: str, seconds: str) -> DataFrame:
    return events.groupBy(F.col(function).alias("function")).agg(
        F.count("*").alias("n"), F.sum(seconds).alias("total"), F.max(seconds).alias("high"), F.avg(seconds).alias("mean")
    )


def compare_gold(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Spans (doc_id, etype, ordinal, start, end) of two runs side by side; rows that differ, with what differs."""
    keys = ["doc_id", "etype", "ordinal"]
    a = found.select(*keys, F.struct("start", "end").alias("mine"))
    b = gold.select(*keys, F.struct("start", "end").alias("theirs"))
    both = a.join(b, keys, "full_outer").where(~F.col("mine").eqNullSafe(F.col("theirs")))
    return both.withColumn("problem", F.when(F.col("mine").isNull(), "missing").when(F.col("theirs").isNull(), "extra").otherwise("moved"))


def compare_counts(found: DataFrame, gold: DataFrame) -> DataFrame:
    """doc_id, etype, n_found, n_gold of the documents and types whose numbers of spans differ between two runs; spans of such a type
    can't be held side by side.  Each run is counted before the two meet; a type that one run lacks has 0 there.
    """
    keys = ["doc_id", "etype"]
    a = found.groupBy(*keys).agg(F.count("*").alias("n"))
    b = gold.groupBy(*keys).agg(F.count("*").alias("n"))
    both = a.withColumnRenamed("n", "n_found").withColumn("n_gold", F.lit(0)).unionByName(b.withColumnRenamed("n", "n_gold").withColumn("n_found", F.lit(0)))
    return both.groupBy(*keys).agg(F.sum("n_found").alias("n_found"), F.sum("n_gold").alias("n_gold")).where("n_found <> n_gold")


def sums_before(values: np.ndarray, start: float = 0.0) -> np.ndarray:
    """For each value ``start`` and all values before it, added up as DuckDB's windows do: the values are leaves of a tree with FAN
    children a node, and whole nodes are added first, from the left.  Rounding grows with the tree's height, not with the rows."""
    n = len(values)
    rows = np.pad(values, (0, -n % FAN)).reshape(-1, FAN)
    first = np.full(1, start) if n <= FAN else sums_before(np.add.accumulate(rows, axis=1)[:, -1], start)
    return np.add.accumulate(np.column_stack([first, rows]), axis=1)[:, :-1].ravel()[:n]


def _whole_sum(key: tuple, rows: pa.Table) -> pa.Table:
    """The node over a chunk."""
    nodes = np.zeros(CHUNK)
    nodes[rows["place"].to_numpy() % CHUNK] = rows["term"].to_numpy()
    while len(nodes) > 1:
        nodes = np.add.accumulate(nodes.reshape(-1, FAN), axis=1)[:, -1]
    return pa.table({"stage": rows["stage"][:1], "chunk": rows["chunk"][:1], "node": nodes})


def _chunk_bounds(key: tuple, rows: pa.Table) -> pa.Table:
    """Sums before and up to the end of a stage's chunks."""
    rows = rows.sort_by("chunk")
    sums = sums_before(np.append(rows["node"].to_numpy(), 0.0))
    return pa.table({"stage": rows["stage"], "chunk": rows["chunk"], "begin": sums[:-1], "finish": sums[1:]})


def _line_rows(every: int, columns: list[str]):
    """Rows of a chunk that are shown, with the mean so far."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        n, begin, finish = rows["n"].to_numpy(), rows["begin"][0].as_py(), rows["finish"][0].as_py()
        sums = sums_before(np.append(rows["term"].to_numpy(), 0.0)[:CHUNK], begin)[1:]
        if len(sums) < len(n):  # a full chunk ends where the next one begins
            sums = np.append(sums, finish)
        mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
        shown = np.flatnonzero(n % every == 0)
        return rows.append_column("mean", mean).select(columns).take(shown)

    return run


def log_line_stats(runs: DataFrame, order: str, every: int, range_rows: int = scan.RANGE_ROWS) -> DataFrame:
    """Cumulative statistics of ``seconds`` by ``stage``, a row for every ``every`` valid runs of a stage in order, nulls last.

    All but the mean are a prefix scan over ranges, so a stage that all runs have is spread over all tasks.  Sums of doubles depend on
    the order of the additions: the mean is that of DuckDB's windows to the last bit (see ``sums_before``), made of chunks of CHUNK
    runs; what one task holds of a whole stage is one number a chunk.
    """
    v, columns = "seconds", ["n", "stage", "mean", "std", "low", "high"]
    found = scan.running(runs.select("stage", order, v), "stage", order, v, range_rows).drop("mean")
    found = found.withColumns({"chunk": F.expr(f"place div {CHUNK}"), "term": F.coalesce(F.col(v).cast("double"), F.lit(0.0))})
    kind = {x.name: x.dataType.simpleString() for x in found.withColumn("mean", F.lit(0.0)).schema}
    stage = f"stage {kind['stage']}, chunk long"
    nodes = found.select("stage", "chunk", "place", "term").groupBy("stage", "chunk").applyInArrow(_whole_sum, f"{stage}, node double")
    limits = nodes.groupBy("stage").applyInArrow(_chunk_bounds, f"{stage}, begin double, finish double")
    a, b = found.select(*[c for c in columns if c != "mean"], "place", "chunk", "term"), limits.withColumnsRenamed({"stage": "of", "chunk": "nth"})
    both = a.join(b, F.col("stage").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("nth"))).drop("of", "nth")
    return both.groupBy("stage", "chunk").applyInArrow(_line_rows(every, columns), ", ".join(f"{c} {kind[c]}" for c in columns))


def sampled(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows (all if there are fewer) drawn at random without repeats; the seed decides."""
    return ids.orderBy(F.xxhash64(*ids.columns, F.lit(seed)), *ids.columns).limit(n)
