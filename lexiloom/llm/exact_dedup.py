"""Exact dedup against a minimal perfect hash of historical digests.

The distinct SHA-256 digests of the history are dealt to shards of a bounded size.  Each shard gets a minimal
perfect hash (levels of collision-free bits; the rank of a bit is the slot) whose slots hold the full digest
and the locator of the winner, the largest doc_id.  A new digest is looked up in its shard's slot and is a
member only if all 32 bytes are equal; members take part in their historical group, the others are grouped
among themselves.

Results for odd input: a null text counts as empty; of repeated rows (same doc_id and text) one stays; a null
doc_id never wins against another and its group keeps keep_id null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, table

#: Digests a shard holds about, and the least number of shards, for parallelism.
SHARD_SIZE, LEAST_SHARDS = 50_000, 64
#: Copies of one row that a task makes alone.
COPIES = 100_000
#: Bits per key in each level; over 1 so that few levels are needed.
GAMMA = 1.6
INDEX_SCHEMA = "shard int, n int, sizes array<int>, bits binary, digests binary, winners binary, known binary, counts binary"


def _slots(words: np.ndarray, size: int, level: int) -> np.ndarray:
    """Place of each key in a level: two of the digest's four words mixed with the level's number."""
    x = words[:, level % 4] ^ (words[:, (level // 4 + 1) % 4] * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
    x ^= x >> np.uint64(31)
    return (x % np.uint64(size)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits end to end, and the slot of each of the distinct digests (n x 32 bytes)."""
    words = digests.view(np.uint64).reshape(-1, 4)
    left, sizes, levels, where = np.arange(len(words)), [], [], np.zeros(len(words), np.int64)
    base = 0
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        at = _slots(words[left], size, len(sizes))
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        where[left[placed]] = base + at[placed]
        sizes.append(size)
        levels.append(alone)
        base += size
        left = left[~placed]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    rank = np.cumsum(bits) - 1
    return sizes, bits, rank[where] if len(words) else where


def find_slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest; -1 where no level claims it.  A slot may belong to another digest: compare."""
    words = digests.view(np.uint64).reshape(-1, 4)
    rank = np.cumsum(bits) - 1
    out, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = base + _slots(words[left], size, level)
        found = bits[at]
        out[left[found]] = rank[at[found]]
        left, base = left[~found], base + size
    return out


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32).copy()


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    sizes, bits, slot = build_hash(digests)
    order = np.argsort(slot)
    known = pdf["known"].to_numpy(bool)  # a text that only rows without an id have is known without a winner
    winners, counts = pdf["winner"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    return pd.DataFrame(
        {
            "shard": [pdf["shard"].iloc[0]],
            "n": [len(pdf)],
            "sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [digests[order].tobytes()],
            "winners": [winners[order].tobytes()],
            "known": [np.packbits(known[order]).tobytes()],
            "counts": [counts[order].tobytes()],
        }
    )


def _probe(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = new[["digest", "winner", "known", "n"]].copy()
    out["history_winner"], out["history_known"], out["history_n"] = np.int64(0), False, np.int64(0)
    if len(index) and len(new):
        row = index.iloc[0]
        sizes = [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool)
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        asked = _matrix(new["digest"])
        slot = find_slots(asked, sizes, bits)
        member = (slot >= 0) & (held[slot] == asked).all(axis=1)
        winners, counts = np.frombuffer(row["winners"], np.int64), np.frombuffer(row["counts"], np.int64)
        known = np.unpackbits(np.frombuffer(row["known"], np.uint8))[: len(winners)].astype(bool)
        out["history_winner"] = np.where(member, winners[slot], np.int64(0))
        out["history_known"] = member & known[slot]
        out["history_n"] = np.where(member, counts[slot], np.int64(0))
    return out


def digested(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the text's digest; nothing else of the table is read."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest")
    )


def _whole(groups: DataFrame) -> DataFrame:
    """``groups`` with no null winner, but whether it is known: pandas holds a long column with a null as floats, which round ids over
    2**53."""
    return groups.withColumn("known", F.col("winner").isNotNull()).withColumn("winner", F.coalesce("winner", F.lit(0).cast("long")))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("n"))


def shard_of(shards: int) -> Column:
    """By the digest's first 31 bits, which are uniform."""
    return (F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % shards).cast("int")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row a shard (INDEX_SCHEMA) from distinct (digest, winner, n); can be kept as a table."""
    return _whole(groups).withColumn("shard", shard_of(shards)).groupBy("shard").applyInPandas(_build, INDEX_SCHEMA)


def resolve(history: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """digest, keep_id and group_size of every distinct digest of either side (rows: doc_id, digest, n)."""
    old = _groups(history)
    index = build_index(old, shards)
    asked = _whole(_groups(new)).withColumn("shard", shard_of(shards))
    probed = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(
        _probe, "digest binary, winner long, known boolean, n long, history_winner long, history_known boolean, history_n long"
    )
    found = probed.select(
        "digest",
        F.greatest(F.when(F.col("known"), F.col("winner")), F.when(F.col("history_known"), F.col("history_winner"))).alias("winner"),
        (F.col("n") + F.col("history_n")).alias("n"),
    )
    # what only the history holds stays as it is; max and max agree for what both hold
    both = found.unionByName(old)
    return both.groupBy("digest").agg(F.max("winner").alias("keep_id"), F.max("n").alias("group_size"))


def dedup(df: DataFrame, is_history: Column, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest and n (rows equal in id and text) for every row of ``df``.

    ``is_history`` tells the rows that came earlier; any split gives the same groups, and both parts are
    returned whole.  Groups are combined per map task before each shuffle, so a hot text is no hot task; the
    join that gives each row its group can be split by AQE.
    """
    shards = max(LEAST_SHARDS, -(-df.count() // SHARD_SIZE))
    rows = digested(df, text).groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    rows = materialise(rows, "digests").withColumn("old", F.coalesce(is_history, F.lit(False)))
    groups = resolve(rows.where("old"), rows.where("NOT old"), shards)
    # written first, so that both sides of the join are exchanges and AQE can split a hot digest
    joined = rows.drop("old").join(materialise(groups, "digest-groups"), "digest")
    copies = repeated(joined)
    kept = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("copy") == 1)
    return copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", "n")


def repeated(rows: DataFrame, most: int = COPIES) -> DataFrame:
    """Each row ``n`` times, with its number ``copy`` from 1.

    Rows of over ``most`` copies are first made into runs of that many, which are dealt out, so no task makes a hot row alone.
    """
    few = rows.where(f"n <= {most}").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    runs = rows.where(f"n > {most}").withColumn("from", F.explode(F.expr(f"sequence(1L, n, {most}L)"))).repartition("digest", "from")
    many = runs.withColumn("copy", F.explode(F.expr(f"sequence(from, least(n, from + {most - 1}L))"))).drop("from")
    return few.unionByName(many)


def earlier_half() -> Column:
    """The query's history: rows whose id hashes to an even number, as if one half had come the day before."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"), earlier_half())
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest", "n")


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns: one of each group of equal texts.

    The texts are shuffled once, for the join on id and digest; only rows that are repeated whole are numbered.
    """
    names, own = df.columns, {"id": "__id", "digest": "__digest"}
    while set(own.values()) & set(names):
        own = {k: v + "_" for k, v in own.items()}
    one, digest = own["id"], own["digest"]
    won = dedup(df, earlier_half()).where("kept").select(F.col("doc_id").alias(one), F.col("digest").alias(digest), "n")
    won = materialise(won, "digests-kept")
    mine = df.withColumn(digest, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).withColumn(one, F.col("doc_id").cast("long"))
    same = [mine[digest] == won[digest], mine[one].eqNullSafe(won[one])]
    back = [F.col(f"`{c}`") for c in names]
    again = won.where("n > 1")
    if again.isEmpty():
        return mine.join(won, same, "left_semi").select(*back)
    some = [mine[digest] == again[digest], mine[one].eqNullSafe(again[one])]
    single = mine.join(again, some, "left_anti").join(won, same, "left_semi").select(*back)
    nth = F.row_number().over(Window.partitionBy(digest, one).orderBy(F.lit(1)))
    numbered = mine.join(again, some, "left_semi").withColumn(one + "n", nth).where(F.col(one + "n") == 1)
    return single.unionByName(numbered.select(*back))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": """
WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM a WINDOW w AS (PARTITION BY text_sha256)"""
}
