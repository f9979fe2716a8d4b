"""Heap Lloyd codes and hard negatives against plain searches."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import hard_negatives, heap_lloyd

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"
NAN, INF = float("nan"), float("inf")


def plain_codes(x: np.ndarray, parts: int, entries: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        code = d.argmin(2)
        if r < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    mine = x[code[:, p] == e, p]
                    if len(mine):
                        books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    return code, d.min(2).sum(1), books


@pytest.mark.parametrize(("rows", "entries", "rounds"), [(900, 64, 2), (700, 16, 9), (10, 64, 2)])
def test_codes_equal_plain_lloyd(spark, monkeypatch, rows, entries, rounds):
    monkeypatch.setattr(heap_lloyd, "BLOCK", 150)
    rng = np.random.default_rng(rows)
    centres = rng.normal(size=(12, 32))
    x = (centres[rng.integers(0, 12, rows)] + 0.2 * rng.normal(size=(rows, 32))).astype(np.float32)
    x[rows // 2 :: 7] = x[0]  # many equal vectors, and ties
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(rows)], "vec_id long, embedding array<float>, label int").repartition(3)
    blocks, books, shares = heap_lloyd.train(heap_lloyd.integers(df), 16, entries, rounds)
    v = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    code, error, expected = plain_codes(v, 16, entries, rounds)
    assert (books == expected).all()
    got = {r.vec_id: (r.code, r.error) for r in heap_lloyd.encoded(blocks, books, "int").collect()}
    assert got == {i: ("".join(f"{c:02x}" for c in code[i]), error[i]) for i in range(rows)}
    assert shares[0] == 1 and len(shares) == rounds + 1
    if rounds == 9:  # late rounds move little: heaps leave most parts alone
        assert shares[-1] < 0.5
    one = heap_lloyd.decode(spark.createDataFrame([(got[0][0],), (None,)], "code string"), books).collect()
    assert one[1].decoded is None and np.abs(np.array(one[0].decoded) * 256 - 0.5 - v[0]).max() ** 2 <= error[0]


def test_codes_of_odd_rows(spark, tmp_path):
    good = [0.5, -0.25] * 16
    rows = [(5, good, 1, "c", "e"), (4, None, 1, "c", "e"), (3, [*good[:-1], None], 1, "c", "e"), (2, [*good[:-1], NAN], None, "c", "e")]
    rows += [(1, [*good[:-1], INF], 1, "c", "e"), (0, [], 1, "c", "e"), (7, [0.0] * 32, None, "c", "e"), (5, good, None, "c", "e"), (None, good, 2, "c", "e")]
    rows += [(9, [1.0] * 16, 1, "c", "e"), (8, [1.0] * 31, 1, "c", "e"), (11, [1e9] * 32, 1, "c", "e")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = heap_lloyd.op12_vector_codes(spark, f"file://{tmp_path}").collect()
    assert sorted(str(r.vec_id) for r in got) == ["5", "5", "7", "None"] and {r.error for r in got} == {0} and {r.label_error for r in got} == {0}
    books = ",".join(map(str, ([128, -64] * 2 + [0, 0] + [128, -64]) * 0 + [x for _ in range(16) for x in (128, -64, 128, -64, 0, 0, 128, -64)]))
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(books.encode()).hexdigest()}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert heap_lloyd.op12_vector_codes(spark, f"file://{tmp_path}/none").count() == 0
    assert hard_negatives.op13_hard_negatives(spark, f"file://{tmp_path}/none").count() == 0


def plain_negatives(rows: list[tuple], positives: int, negatives: int, low: int, high: int) -> set[tuple]:
    out = set()
    for a, la, x in rows:
        if a % 100 == 0:
            score = [(-int(x @ y), b, lb) for b, lb, y in rows if b != a and len(x) == len(y)]
            for s, p, _ in sorted(t for t in score if t[2] == la)[:positives]:
                fit = sorted(t for t in score if t[2] != la and low * -s <= 100 * -t[0] <= high * -s)[:negatives]
                out |= {(a, p, i + 1, t[1], -s, -t[0]) for i, t in enumerate(fit)}
    return out


@pytest.mark.parametrize(("seed", "scale", "block", "leaf"), [(1, 1, 10_000, 16), (2, 1, 120, 8), (3, 400, 200, 128)])
def test_negatives_equal_plain_search(spark, monkeypatch, seed, scale, block, leaf):
    """Clustered vectors, many equal ones, unlike norms, negative scores, several blocks."""
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "SMALL_BLOCK", block)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 12))
    x = centres[rng.integers(0, 9, 900)] * rng.uniform(0.1, 2, (900, 1)) + 0.3 * rng.normal(size=(900, 12))
    x[100:180] = x[100]
    v = np.floor(x * 20 * scale).astype(np.int64)
    labels = rng.integers(0, 4, 900)
    ids = [*range(880), 5, 5, 700, 700, *range(884, 900)]  # ids that repeat
    ids[884:886] = [900, 1000]
    df = spark.createDataFrame([(i, int(y), w.tolist()) for i, y, w in zip(ids, labels, v, strict=True)], "vec_id long, label long, v array<int>")
    df = df.where("vec_id <> 700 OR label = 0").dropDuplicates(["vec_id", "label", "v"]) if seed == 0 else df.where("vec_id <> 700")
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, block=block).collect()
    rows = [(i, int(y), w) for i, y, w in zip(ids, labels, v, strict=True) if i != 700]
    expected = plain_negatives(rows, 5, 10, 30, 90)
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected and len(expected) > 100


def test_tree_visits_few_leaves_of_clustered_rows():
    """Recall is one by construction; on clusters the bounds leave leaves out."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 200
    x = np.floor(centres[rng.integers(0, 40, 8_000)] + rng.normal(size=(8_000, 16))).astype(np.int64)
    tree = hard_negatives.Tree(np.arange(8_000), np.zeros(8_000, np.int64), x)
    low, high = tree.bounds(x[17].astype(np.float64))
    d = np.sqrt(np.maximum(0, (x[17] ** 2).sum() + tree.most - 2 * tree.rows @ x[17]))
    leaf = np.empty(len(d), np.int64)
    for i, (a, b) in enumerate(zip(tree.starts, tree.stops, strict=True)):
        leaf[a:b] = i
    assert (d >= low[leaf] - 1e-3).all() and (d <= high[leaf] + 1e-3).all()
    tenth = np.sort(d)[10]
    assert (low <= tenth).mean() < 0.75


def test_negatives_of_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1, "", ""), (1, [1.0, 0.0], 1, "", ""), (2, [0.5, 0.0], 2, "", ""), (3, [0.5, 0.5], None, "", ""), (4, None, 2, "", "")]
    rows += [(5, [0.5, NAN], 2, "", ""), (None, [0.5, 0.0], 2, "", ""), (6, [0.5], 2, "", ""), (100, [0.0, 0.0], 3, "", ""), (8, [0.0, 0.0], 3, "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = hard_negatives.op13_hard_negatives(spark, f"file://{tmp_path}").collect()
    # vec_id 0 is divisible by 7: its label is 2, its positive 2 and its negative 1 scores too much
    zero = {(r.anchor_id, r.positive_id, r.negative_id) for r in got}
    assert zero == {(100, 8, i) for i in (0, 1, 2)} and {r["rank"] for r in got} == {1, 2, 3}
