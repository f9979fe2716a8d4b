"""Repeated-substring dedup against brute force over all windows."""

import collections
import random

import numpy as np
import pytest

from lexiloom.llm import suffix_dedup


def brute(texts: list[str | None], length: int) -> list[tuple[int, list[tuple[int, int]], bytes]]:
    data, seen = [(t or "").encode() for t in texts], collections.Counter()
    for b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        out.append((len(b), list(zip(edges[::2], edges[1::2], strict=True)), bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])))
    return out


def run(spark, texts: list[str | None], length: int) -> list[tuple]:
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], "doc_id long, text string, d1 int, spans int, `a b` string")
    got = suffix_dedup.strip(df.repartition(3), "text", length)
    assert got.columns == ["doc_id", "text", "d1", "a b", "n_bytes", "spans", "kept_text"]
    rows = sorted(got.collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows] == texts
    return [(r.n_bytes, [tuple(s) for s in r.spans], r.kept_text) for r in rows]


def made(rng: random.Random, n: int) -> list[str | None]:
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(rng.randrange(8, 90)) for _ in range(6)]
    out: list[str | None] = []
    for _ in range(n):
        text = " ".join(rng.choice([prose(rng.randrange(0, 40)), rng.choice(passages)]) for _ in range(rng.randrange(0, 5)))
        for _ in range(rng.randrange(0, 3)):  # near copies: a character here and there
            if text:
                i = rng.randrange(len(text))
                text = text[:i] + rng.choice("xyz") + text[i + rng.randrange(0, 2) :]
        out.append(text)
        if rng.random() < 0.2:
            out.append(text)
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, 64), (2, 200), (3, 72)])
def test_against_every_window(spark, seed, length):
    texts = made(random.Random(seed), 60) + [None, "", "a" * 500, "ab" * 300, "abc" * 100 + "d", "x" * (length - 1), "é" * length]
    expected = [(n, spans, kept.decode("utf-8", "replace")) for n, spans, kept in brute(texts, length)]
    got = run(spark, texts, length)
    assert [x[:2] for x in got] == [x[:2] for x in expected]
    assert [g[2] for g in got if "�" not in g[2]] == [e[2] for g, e in zip(got, expected, strict=True) if "�" not in g[2]]


def test_partial_overlaps_of_several_partners(spark):
    """A window whose left half one text shares and whose right half another one does is no repeat; overlapping repeats join."""
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    a, b, c = word(120), word(90), word(150)
    texts = [a + b + c, a + b + word(80), word(50) + b + c, a + word(300), word(70) + a[60:] + b[:40] + word(60)]
    texts += [x[:i] + "Z" + x[i + 1 :] for x in [a + b + c] for i in range(0, 360, 23)]
    assert [x[:2] for x in run(spark, texts, 200)] == [x[:2] for x in brute(texts, 200)]


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 512)
    texts = made(random.Random(5), 15) + ["q" * 3_000 + "r" * 200, "no" * 900]
    data = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    whole = np.frombuffer(b"".join(data), np.uint8)
    cuts = collections.defaultdict(list)
    for _, _, row, start, width, _ in suffix_dedup.find_runs(whole, offsets, 64):
        for r, s, w in zip(row.tolist(), start.tolist(), width.tolist(), strict=True):
            cuts[r] += range(s, s + w + 1)
    assert {r: sorted(x) for r, x in cuts.items()} == {r: list(range(len(b) - 63)) for r, b in enumerate(data) if len(b) >= 64}


def test_odd_tables_and_lengths(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.strip(nothing).count() == 0 and suffix_dedup.strip_texts(nothing).count() == 0
    hot = spark.createDataFrame([(None if i % 3 else i, "same text " * 30) for i in range(500)] + [(1, None)], "doc_id long, text string")
    got = suffix_dedup.strip(hot).groupBy("kept_text", "n_bytes").count().collect()
    assert sorted(map(tuple, got)) == [("", 0, 1), ("", 300, 500)]
    with pytest.raises(ValueError, match="multiple of 8"):
        suffix_dedup.strip_texts(nothing, length=100)
