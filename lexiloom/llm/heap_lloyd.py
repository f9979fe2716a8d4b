"""Vector code compression: product codes whose codebooks are trained by Heap Lloyd.

Vectors are cut into equal parts, and each part position has a codebook.  The rows lie in blocks of bounded size, one row of a
table each, which hold the vectors, the codes and, for each position and entry, a heap of that entry's parts in the block.  A
part's key is the slack between its lower bound (the distance to the second nearest entry) and its upper bound (the distance to
its own), plus the entry's cumulative drift when the key was made; the entry's drift of a round is how far it moved itself plus
the farthest move of any other.  A part can have another nearest entry only if its key is at most the entry's cumulative drift
by now, so a round pops just these off each heap, scans them against all entries in exact integers, and pushes them onto the heap
of their entry.  Bounds are floating point with a margin; all that decides is integer.

A round is one map over the blocks and one sum over entries: a block gives at most entries x positions sums.  Only codebooks
(entries x dimension integers) and those sums' totals pass through the driver.  Blocks are written each round, so that a lost
executor costs the round's blocks it held; no task holds more than one block.

Results for odd input: rows whose vector is null, empty or holds a null or a component that is not finite are dropped, as are
those whose length is not a multiple of the number of parts or not that of the first kept row (the smallest vec_id), and those
with a component of 2**16 or more in size, whose squares might not fit.  Null ids come last among the first rows; repeated ids
are rows of their own, ordered by their components.  With fewer rows than entries each row is an entry; equal entries lose to
the lower index.  An empty table gives no rows.  Columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialise, table

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components times this, rounded down, are what is coded; the largest size of a component; rows of a block.
SCALE, LARGEST, BLOCK = 256, 1 << 16, 4_096

BLOCK_SCHEMA = "state binary, sums binary, scanned long, total long"


def integers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and the vector in integers (``v``) of the rows that can be coded, whatever their length."""
    x = F.col(vector)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    rows = df.where(x.isNotNull() & (F.size(x) > 0) & F.coalesce(fit, F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).try_cast("int"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


def seeds(rows: DataFrame, parts: int, entries: int) -> list[list[int]]:
    """The first kept vectors, by vec_id; their length is that of all."""
    cut = rows.where(F.size("v") % parts == 0)
    first = cut.orderBy(F.col("vec_id").asc_nulls_last(), "v").first()
    if first is None:
        return []
    same = cut.where(F.size("v") == len(first.v))
    return [r.v for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, its squared distance and that of the next one, of each part; in integers, ties to the lower index."""
    best = np.empty(len(x), np.int64)
    one, two = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), 1_024):
        d = ((x[i : i + 1_024, None, :] - book[None]) ** 2).sum(2)
        at = d.argmin(1)
        rows = np.arange(len(at))
        best[i : i + 1_024], one[i : i + 1_024] = at, d[rows, at]
        d[rows, at] = np.iinfo(np.int64).max
        two[i : i + 1_024] = d.min(1)
    return best, one, two


class Block:
    """Vectors of a block, their codes, and a heap of (key, row) for each position and entry."""

    def __init__(self, ids: list, labels: pa.Array, vectors: np.ndarray, parts: int, entries: int):
        self.ids, self.labels, self.parts, self.entries = ids, labels, parts, entries
        least = next(t for t in (np.int16, np.int32) if vectors.size == 0 or np.abs(vectors).max() < np.iinfo(t).max)
        self.vectors = vectors.astype(least)
        self.codes = np.zeros((len(ids), parts), np.uint16)
        self.heaps: list[list[list]] = []

    def step(self, books: np.ndarray, drift: np.ndarray) -> int:
        """Assign to ``books`` (position, entry, component), ``drift`` (position, entry) being cumulative; returns the parts scanned."""
        x, scanned = self.vectors.astype(np.int64).reshape(len(self.ids), self.parts, -1), 0
        first = not self.heaps
        if first:
            self.heaps = [[[] for _ in range(self.entries)] for _ in range(self.parts)]
        largest = float(max(np.abs(books).max(initial=1), np.abs(x).max(initial=1)))
        margin = 1e-6 + 1e-12 * largest * x.shape[2]
        for p in range(self.parts):
            heaps = self.heaps[p]
            if first:
                rows = np.arange(len(x))
            else:
                popped = []
                for heap, far in zip(heaps, (drift[p] + margin).tolist(), strict=True):
                    while heap and heap[0][0] <= far:
                        popped.append(heapq.heappop(heap)[1])
                rows = np.array(popped, np.int64)
            if not len(rows):
                continue
            best, one, two = _nearest(x[rows, p], books[p])
            self.codes[rows, p] = best
            scanned += len(rows)
            keys = np.sqrt(two.astype(np.float64)) - np.sqrt(one.astype(np.float64)) + drift[p][best]
            for key, row, entry in zip(keys.tolist(), rows.tolist(), best.tolist(), strict=True):
                heapq.heappush(heaps[entry], (key, row))
        return scanned

    def sums(self) -> np.ndarray:
        """Number and component sums of each entry's parts (position, entry, 1 + components)."""
        x = self.vectors.astype(np.int64).reshape(len(self.ids), self.parts, -1)
        out = np.zeros((self.parts, self.entries, 1 + x.shape[2]), np.int64)
        for p in range(self.parts):
            np.add.at(out[p, :, 0], self.codes[:, p], 1)
            np.add.at(out[p, :, 1:], self.codes[:, p], x[:, p])
        return out

    def errors(self, books: np.ndarray) -> np.ndarray:
        x = self.vectors.astype(np.int64).reshape(len(self.ids), self.parts, -1)
        out = np.zeros(len(x), np.int64)
        for p in range(self.parts):
            out += ((x[:, p] - books[p][self.codes[:, p]]) ** 2).sum(1)
        return out


def _row(block: Block, books: np.ndarray, drift: np.ndarray) -> pa.RecordBatch:
    scanned = block.step(books, drift)
    state = pickle.dumps(block, protocol=5)
    data = [[state], [block.sums().tobytes()], [scanned], [len(block.ids) * block.parts]]
    return pa.RecordBatch.from_arrays([pa.array(data[0], pa.binary()), pa.array(data[1], pa.binary()), *map(pa.array, data[2:])], ["state", "sums", "scanned", "total"])


def _first(books: np.ndarray, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drift = np.zeros(books.shape[:2])
        for whole in batches:
            for i in range(0, len(whole), BLOCK):
                batch = whole.slice(i, BLOCK)
                vectors = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
                labels = pa.array(batch.column(1).to_pylist(), batch.column(1).type)  # a slice would keep all of its batch
                block = Block(batch.column(0).to_pylist(), labels, vectors, parts, books.shape[1])
                yield _row(block, books, drift)

    return run


def _next(books: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.column(0):
                yield _row(pickle.loads(memoryview(state.as_buffer())), books, drift)

    return run


def _totals(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Sums over all blocks: added within a task, then by position and entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64).reshape(shape)
        slot = np.flatnonzero(total[:, :, 0].ravel())
        rows = total.reshape(-1, shape[2])[slot]
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(list(rows), pa.list_(pa.int64()))], ["slot", "sums"])

    each = blocks.select("sums").mapInArrow(add, "slot long, sums array<long>")
    one = each.select("slot", F.posexplode("sums").alias("at", "x")).groupBy("slot", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = np.zeros((shape[0] * shape[1], shape[2]), object)
    for r in one.collect():  # entries x (dimension + positions) numbers, whatever the number of rows
        out[r.slot, r["at"]] = int(r.x)
    return out.reshape(shape)


def moved(books: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next codebooks, and each entry's drift: its own move and the farthest of the others."""
    out = books.copy()
    for p, e in zip(*np.nonzero(totals[:, :, 0] > 0), strict=True):
        out[p, e] = [int(s) // int(totals[p, e, 0]) for s in totals[p, e, 1:]]
    move = np.sqrt(((out - books).astype(np.float64) ** 2).sum(2))
    other = np.zeros_like(move)
    for e in range(move.shape[1]):
        other[:, e] = np.delete(move, e, axis=1).max(axis=1, initial=0.0)
    return out, (move + other) * (1 + 1e-12)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray, list[float]]:
    """Blocks with final codes, the codebooks (position, entry, component), and the share of parts that each assignment scanned.

    ``rows``: as from ``integers``.  No blocks come of no rows.
    """
    start = seeds(rows, parts, entries)
    if not start:
        return None, np.zeros((parts, 0, 0), np.int64), []
    books = np.array(start, np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    drift = np.zeros(books.shape[:2])
    same = rows.where(F.size("v") == len(start[0]))
    blocks = materialise(same.mapInArrow(_first(books, parts), BLOCK_SCHEMA), "code-blocks")
    shares = [1.0]
    for _ in range(rounds):
        books, far = moved(books, _totals(blocks, (*books.shape[:2], books.shape[2] + 1)))
        drift = drift + far
        before, blocks = blocks, materialise(blocks.select("state").mapInArrow(_next(books, drift), BLOCK_SCHEMA), "code-blocks")
        discard(before)
        seen = blocks.agg(F.sum("scanned"), F.sum("total")).first()
        shares.append(seen[0] / max(1, seen[1]))
    return blocks, books, shares


def encoded(blocks: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.column(0):
                block = pickle.loads(memoryview(state.as_buffer()))
                names = ["".join(f"{c:02x}" for c in row) for row in block.codes.tolist()]
                columns = [pa.array(block.ids, pa.int64()), block.labels, pa.array(names, pa.string()), pa.array(block.errors(books))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return blocks.select("state").mapInArrow(run, f"vec_id long, label {label_type}, code string, error long")


def decode(df: DataFrame, books: np.ndarray, code: str = "code", out: str = "decoded") -> DataFrame:
    """Add ``out``: the vector of floats that a code stands for (the middle of its integers' ranges); null codes give null."""
    flat = [[[(int(x) + 0.5) / SCALE for x in entry] for entry in book] for book in books]

    @F.arrow_udf("array<double>")
    def vectors(codes: pa.Array) -> pa.Array:
        made = [None if c is None else [x for p, book in enumerate(flat) for x in book[int(c[2 * p : 2 * p + 2], 16)]] for c in codes.to_pylist()]
        return pa.array(made, pa.list_(pa.float64()))

    return df.withColumn(out, vectors(F.col(code)))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    blocks, books, _ = train(rows)
    kind = rows.schema["label"].dataType.simpleString()
    if blocks is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    found = materialise(encoded(blocks, books, kind), "codes")
    each = materialise(found.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    own, other = found.alias("a"), each.alias("b")
    joined = own.join(other, F.col("a.label").eqNullSafe(F.col("b.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _books(k: int) -> str:
    """SQL of one round: nearest entries of c{k}, then the entries c{k + 1}."""
    return f"""
a{k} AS (
    SELECT p.rid, p.pos, min(struct_pack(d := list_sum(list_transform(range(1, len(p.w) + 1), lambda i: (p.w[i] - c.w[i]) * (p.w[i] - c.w[i]))), e := c.e)) AS best
    FROM p JOIN c{k} c ON p.pos = c.pos GROUP BY p.rid, p.pos),
s{k} AS (
    SELECT pos, e, list(m ORDER BY i) AS w FROM (
        SELECT p.pos, a.best.e AS e, i, CAST((sum(p.w[i]) - ((sum(p.w[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
        FROM p JOIN a{k} a ON p.rid = a.rid AND p.pos = a.pos, range(1, 65) t(i) WHERE i <= len(p.w) GROUP BY p.pos, a.best.e, i) GROUP BY pos, e),
c{k + 1} AS (SELECT c.pos, c.e, coalesce(s.w, c.w) AS w FROM c{k} c LEFT JOIN s{k} s ON c.pos = s.pos AND c.e = s.e)"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {
    "op12_vector_codes": f"""
WITH e AS (
    SELECT row_number() OVER (ORDER BY vec_id, v) AS rid, vec_id, label, v FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT rid, pos, v[pos * (len(v) // 16) + 1 : (pos + 1) * (len(v) // 16)] AS w FROM e, range(16) t(pos)),
c0 AS (SELECT pos, rid - 1 AS e, w FROM p WHERE rid <= 64),{_books(0)},{_books(1)},
a2 AS (
    SELECT p.rid, p.pos, min(struct_pack(d := list_sum(list_transform(range(1, len(p.w) + 1), lambda i: (p.w[i] - c.w[i]) * (p.w[i] - c.w[i]))), e := c.e)) AS best
    FROM p JOIN c2 c ON p.pos = c.pos GROUP BY p.rid, p.pos),
r AS (
    SELECT rid, string_agg(lower(printf('%02x', CAST(best.e AS INTEGER))), '' ORDER BY pos) AS code, CAST(sum(best.d) AS BIGINT) AS error
    FROM a2 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM c2)
SELECT e.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM e JOIN r ON e.rid = r.rid CROSS JOIN h"""
}
