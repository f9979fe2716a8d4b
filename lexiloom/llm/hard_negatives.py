"""Hard-negative mining: vantage-point trees over norm-augmented vectors.

A row x gets one more component, sqrt(M - |x|^2) with M the greatest squared norm of its block, and a query a zero, so that the
squared distance of query and row is |q|^2 + M - 2 q.x: higher scores are nearer, and a window of scores is an annulus around the
query.  Rows are dealt by a hash of their id to blocks of about BLOCK rows; each block has a vantage-point tree whose leaves hold
at most LEAF rows.  A query gets, from the distances to the tree's vantage points, a lower and an upper bound for every leaf; the
leaves are visited nearest first, those beyond the annuli's outer or wholly within their inner radius never, and a window is done
with a block once it has k rows that no unvisited leaf can beat.  Bounds are floating point with a margin; scores are integers.

All anchors meet all blocks: a block's rows come first and then the anchors, streamed in the task, so that memory holds one block
and one batch of anchors.  Each (anchor, block) gives at most k rows a window, and the k best of all blocks stay; row_number with
a limit is cut within tasks before it is shuffled.  There is no pair of any two rows in a shuffle.

The first pass finds the positives (rows of the anchor's own label, no window), the second the negatives in the windows that the
positives give.  Rules for labels are the caller's.

Results for odd input: rows with a null label, a null vector, a null component or one that is not finite take no part, nor do
those with a component of 2**16 or more in size, whose scores might not fit, or an empty vector; vectors of different lengths never
meet, their score being taken as absent.  Rows with a null id take no part, as they can't be named; of rows that share an id each
is a row of its own, but only the one of least label and vector can be an anchor, and no row of the anchor's id is its positive or
negative.  An empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, table
from lexiloom.llm.heap_lloyd import integers

#: Rows of a block about (and of the least that is worth a task of its own), of a leaf, and leaves that a query visits at once.
BLOCK, SMALL_BLOCK, LEAF, VISIT = 65_536, 4_096, 128, 8
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score.
LOW, HIGH = 30, 90

HIT_SCHEMA = "anchor_id long, place int, id long, score long"


class Tree:
    """A vantage-point tree over the rows of one block, all of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        norms = (x**2).sum(1)
        self.most = float(norms.max())
        extra = np.sqrt(self.most - norms)
        order, self.nodes, self.leaves = np.arange(len(x)), [], []
        self._grow(order, x, extra)
        self.ids, self.labels = ids[order], labels[order]
        self.rows = x[order]
        places = np.array(self.nodes, np.int64)
        self.vantage = np.hstack([x[places], extra[places, None]]) if len(places) else np.zeros((0, x.shape[1] + 1))
        self.starts = np.array([leaf[0] for leaf in self.leaves], np.int64)
        self.stops = np.array([leaf[1] for leaf in self.leaves], np.int64)
        depth = max(len(leaf[2]) for leaf in self.leaves)
        self.path = np.full((len(self.leaves), depth), -1, np.int64)
        self.low, self.high = np.zeros((len(self.leaves), depth)), np.full((len(self.leaves), depth), np.inf)
        for i, leaf in enumerate(self.leaves):
            for j, (node, low, high) in enumerate(leaf[2]):
                self.path[i, j], self.low[i, j], self.high[i, j] = node, low, high
        self.depth = depth

    def _grow(self, order: np.ndarray, x: np.ndarray, extra: np.ndarray) -> None:
        """Split by the distance to a vantage point (the row farthest from the part's first one) at the median."""
        todo = [(0, len(order), [])]
        while todo:
            begin, end, path = todo.pop()
            mine = order[begin:end]
            if end - begin <= LEAF:
                self.leaves.append((begin, end, path))
                continue
            far = int(mine[int(((x[mine] - x[mine[0]]) ** 2).sum(1).argmax())])
            d = np.sqrt(((x[mine] - x[far]) ** 2).sum(1) + (extra[mine] - extra[far]) ** 2)
            half = len(mine) // 2
            by = np.argpartition(d, half)
            order[begin:end], d = mine[by], d[by]
            node = len(self.nodes)
            self.nodes.append(far)
            todo.append((begin, begin + half, [*path, (node, float(d[:half].min()), float(d[:half].max()))]))
            todo.append((begin + half, end, [*path, (node, float(d[half:].min()), float(d[half:].max()))]))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the query's distance to the rows of each leaf."""
        norm = float((q**2).sum())
        limit = np.sqrt(norm) + np.sqrt(self.most)  # of any distance
        if not self.depth:
            return np.zeros(len(self.starts)), np.full(len(self.starts), limit)
        # a node's number -1 stands for no node: its distance is of no effect
        d = np.sqrt(((self.vantage[:, :-1] - q) ** 2).sum(1) + self.vantage[:, -1] ** 2)
        d = np.append(d, 0.0)[self.path]
        low = np.where(self.path < 0, 0.0, np.maximum(d - self.high, self.low - d)).max(1)
        high = np.where(self.path < 0, np.inf, d + self.high).min(1)
        return np.maximum(low, 0.0), np.minimum(high, limit)

    def search(self, anchor: int, label: int, q: np.ndarray, windows: list[tuple[int, int, int]], k: int, same: bool) -> Iterator[tuple[int, int, int]]:
        """(window's place, id, score) of the k rows of greatest score (ties: smallest id) for each window (place, least and greatest
        score), of the anchor's label (``same``; rows of its own id left out) or of the others."""
        qf = q.astype(np.float64)
        total = float((qf**2).sum()) + self.most
        slack = 1e-6 * (1 + np.sqrt(max(total, 0.0)))
        low, high = self.bounds(qf)
        nearest = lambda least: np.sqrt(np.maximum(0.0, total - 2.0 * least))  # noqa: E731  distance of a score
        bars = np.array([(a, b) for _, a, b in windows], np.float64)
        outer, inner = nearest(bars[:, 0]) + slack, nearest(bars[:, 1]) - slack
        use = np.flatnonzero(((low[:, None] <= outer) & (high[:, None] >= inner)).any(1))
        use = use[np.argsort(low[use], kind="stable")]
        exact = self.most * float((qf**2).sum()) < 2.0**104  # all sums of products stay under 2**52
        hits: list[list[tuple[int, int]]] = [[] for _ in windows]
        done = np.zeros(len(windows), bool)
        for i in range(0, len(use), VISIT):
            for w in np.flatnonzero(~done):
                if low[use[i]] > outer[w] or (len(hits[w]) >= k and low[use[i]] > nearest(-hits[w][k - 1][0]) + slack):
                    done[w] = True
            if done.all():
                break
            at = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[use[i : i + VISIT]], self.stops[use[i : i + VISIT]], strict=True)])
            fit = ((self.labels[at] == label) == same) & (self.ids[at] != anchor)
            at = at[fit]
            score = (self.rows[at] @ qf).astype(np.int64) if exact else self.rows[at].astype(np.int64) @ q.astype(np.int64)
            for w in np.flatnonzero(~done):
                _, least, most = windows[w]
                inside = np.flatnonzero((score >= least) & (score <= most))
                if len(inside) > k:  # the k best of the visited ones, with all ties
                    cut = np.partition(score[inside], -k)[-k]
                    inside = inside[score[inside] >= cut]
                more = zip((-score[inside]).tolist(), self.ids[at[inside]].tolist(), strict=True)
                hits[w] = sorted([*hits[w], *more])[:k]
        for (place, _, _), found in zip(windows, hits, strict=True):
            for score, row in found:
                yield place, row, -score


def _search(k: int, same: bool):
    """Map (block, kind, id, label, v, windows), sorted by block and kind (rows before anchors), to HIT_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, trees = None, [], None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(blocks) | np.diff(kinds)) + 1
            out: list[tuple] = []
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                part = batch.slice(begin, end - begin)
                if blocks[begin] != block:
                    block, held, trees = blocks[begin], [], None
                if kinds[begin] == 0:
                    held.append(part)
                    continue
                if trees is None:
                    trees, held = _trees(held), []
                for i in range(len(part)):
                    v = part.column(4)[i].values.to_numpy()
                    if len(v) in trees:
                        anchor, label = part.column(2)[i].as_py(), part.column(3)[i].as_py()
                        windows = [(x["place"], x["least"], x["most"]) for x in part.column(5)[i].as_py()]
                        out += [(anchor, *hit) for hit in trees[len(v)].search(anchor, label, v, windows, k, same)]
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "place", "id", "score"])

    return run


def _trees(parts: list[pa.RecordBatch]) -> dict[int, Tree]:
    """A tree for each length of vectors in a block."""
    by: dict[int, list] = {}
    for part in parts:
        n = np.asarray(part.column(4).value_lengths())
        ids, labels = part.column(2).to_numpy(), part.column(3).to_numpy()
        for size in np.unique(n).tolist():
            at = np.flatnonzero(n == size)
            rows = part.column(4).take(pa.array(at)).flatten().to_numpy().reshape(len(at), size)
            by.setdefault(size, []).append((ids[at], labels[at], rows))
    return {size: Tree(*(np.concatenate(x) for x in zip(*found, strict=True))) for size, found in by.items()}


def nearest(rows: DataFrame, anchors: DataFrame, k: int, same: bool, blocks: int) -> DataFrame:
    """anchor_id, place, id, score, rank: the k best rows in each window of each anchor.

    ``rows``: vec_id, label, v (integers); ``anchors``: the same and windows, an array of (place, least, most).
    """
    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "v")
    own = own.withColumn("windows", F.lit(None).cast("array<struct<place: int, least: bigint, most: bigint>>"))
    to = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = anchors.select(to, F.lit(1).alias("kind"), "vec_id", "label", "v", "windows")
    dealt = own.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    hits = dealt.mapInArrow(_search(k, same), HIT_SCHEMA)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label (an integer), v (integers).  The windows are ``low`` to ``high`` percent of
    the positive's score.
    """
    rows = materialise(rows.where("vec_id IS NOT NULL AND label IS NOT NULL"), "rows-to-mine")
    n, tasks = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(tasks, -(-n // SMALL_BLOCK)))
    everything = F.array(F.struct(F.lit(0).alias("place"), F.lit(-(1 << 62)).alias("least"), F.lit(1 << 62).alias("most")))
    one = F.min(F.struct("label", "v")).alias("one")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(one).select("vec_id", "one.*")
    first = nearest(rows, anchors.withColumn("windows", everything), positives, True, blocks)
    first = materialise(first.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # a negative score makes an empty window
    least, most = F.expr(f"(positive_score * {low} + 99) div 100"), F.expr(f"positive_score * {high} div 100")
    window = F.struct("place", least.alias("least"), most.alias("most"))
    asked = first.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(window).alias("windows"))
    asked = anchors.join(asked, anchors["vec_id"] == asked["anchor_id"]).drop("anchor_id")
    second = nearest(rows, asked, negatives, False, blocks).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    out = second.join(first, ["anchor_id", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    noisy = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(rows.select("vec_id", noisy.cast("long").alias("label"), "v"), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {
    "op13_hard_negatives": """
WITH e AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
    SELECT * FROM (SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same)
    WHERE r <= 5)
SELECT * FROM (
    SELECT p.anchor_id, p.id AS positive_id,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
        s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id
    WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
WHERE rank <= 10"""
}
