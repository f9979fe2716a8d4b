"""Benchmark decontamination by latent semantic retrieval.

The corpus is read once and each text is encoded by the benchmark's vocabulary.  Document frequencies are counted over
all passages of the corpus; a randomised SVD of the TF-IDF matrix of all passages (one distributed product of
the Gram matrix with a random test matrix, summed in a tree, then a small factorisation) gives the latent space.
Windows of every text are compared with the benchmark's pieces by cosine there; candidates are verified by
the longest common subsequence of words, and the looser ones, paraphrases, also by the answer: its words, or the
piece's rarest words where the benchmark has no answer column, must stand in the window.

Cosine is not the only way to a candidate.  A piece's rarest run of LEAST_WORDS words is sought in every text, so that a
verbatim copy is found whatever its weights are; and a piece of so many common words that a likely copy of it may
hold no weighted one is compared with every window.

The benchmark is the stated query set; it is taken in blocks of BLOCK_WORDS words, so what a task or the driver holds
is bounded by a block's vocabulary.  Each block has a latent space of its own.  Corpus rows are only mapped, never
shuffled.

Results for odd input: null and empty texts match nothing; items of fewer than LEAST_WORDS words match
exact copies only, since changed ones cannot be told from common speech; items without words match nothing; texts are
searched whole; repeated rows give repeated results; several items with one text all match; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import materialise, table, texts

#: Words of a block of the benchmark's items; a longer item is a block of its own.
BLOCK_WORDS = 1 << 17
#: Words of a cell; a window is two cells in a row, a benchmark piece one cell at most, so a window holds it whole.
CELL = 32
LEAST_WORDS = 5
#: Latent dimensions and oversampling of the randomised SVD.
RANK, OVERSAMPLE = 64, 16
#: Terms in more than this share of passages are common and stay out of the vectors.
STOP_SHARE = 0.1
#: Weighted terms that a window needs; least cosine of candidates.
LEAST_TERMS, COSINE = 1, 0.2
#: Least share of a piece's latent length that a candidate window has in the piece's direction.
REACH = 0.35
#: Cells that are searched at once.
CHUNK_CELLS = 1 << 15
#: Share of a piece's words in the common subsequence: enough alone; enough with the answer check.
SURE, LIKELY = 0.7, 0.6
#: Rarest terms of a piece that stand for its answer, and the share of them that must be found.
ANSWER_TERMS, ANSWER_SHARE = 5, 0.6
FAN_IN, TERMS_PER_ROW = 64, 64
#: Passages whose vectors are made at once.
GRAM_PASSAGES = 4096
SCHEMA = "doc_id long, item_id long, cosine double, lcs_words int, coverage double, answer_share double"

#: Factor of the hashes of runs, and bits of the table that most runs of a text end at.
MIX, RUN_BITS = np.uint64(0x9E3779B97F4A7C15), 16
#: Words of 64 bits of a signature, and windows that are compared with all pieces at once.
SIGNED, TILE = 8, 512

_words = re.compile(r"[^\W_]+").findall
#: Characters beyond ASCII that belong to no word; up to FEW different ones of a text are replaced one after the other.
_odd, FEW = re.compile(r"[^\w\x00-\x7f]"), 16
_ASCII = bytes(range(128))
#: ASCII words, and a space for all else; bytes beyond ASCII stay.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_bytes(text: str) -> list[bytes]:
    """What ``_words`` finds, in UTF-8, several times as fast."""
    raw = text.encode()
    if not text.isascii():
        odd = [c for c in set(raw.translate(None, _ASCII).decode()) if not c.isalnum()]
        if len(odd) > FEW:
            raw = _odd.sub(" ", text).encode()
        else:
            for c in odd:
                raw = raw.replace(c.encode(), b" ")
    return raw.translate(_WORD_BYTES).split()


def segment_sums(table: np.ndarray, index: np.ndarray, starts: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows ``table[index]``, times ``scale``, over the segments that begin at ``starts``, none empty: the first rows
    of all segments, then the second ones, and so on, the longest segments first, so that each step is one slice."""
    size = np.diff(np.append(starts, len(index)))
    order = np.argsort(-size, kind="stable")
    first, out = starts[order], np.zeros((len(starts), table.shape[1]), table.dtype)
    rows = np.empty_like(out)
    for k, m in enumerate(np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left").tolist()):
        at = first[:m] + k
        np.take(table, index[at], axis=0, out=rows[:m], mode="clip")
        if scale is not None:
            rows[:m] *= scale[at, None]
        out[:m] += rows[:m]
    rows[order] = out
    return rows


@dataclass
class Piece:
    item: int
    terms: list[int]
    answer: list[int] = field(default_factory=list)
    masks: dict[int, int] = field(default_factory=dict)


@dataclass
class Block:
    """The query side: vocabulary and pieces of a block of items."""

    ids: list[int]
    vocabulary: dict[str, int]
    pieces: list[Piece]


def make_block(items: list[tuple]) -> Block:
    """items: (item_id, text, answer or None)."""
    vocabulary: dict[str, int] = {}
    pieces = []
    for number, (_, text, answer) in enumerate(items):
        terms = [vocabulary.setdefault(w, len(vocabulary)) for w in _words((text or "").lower())]
        own = [vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(_words((answer or "").lower()))]
        if not terms:
            continue
        n = -(-len(terms) // CELL)
        cuts = [len(terms) * i // n for i in range(n + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = Piece(number, terms[a:b], own)
            for i, t in enumerate(piece.terms):
                piece.masks[t] = piece.masks.get(t, 0) | 1 << i
            pieces.append(piece)
    return Block([i for i, _, _ in items], vocabulary, pieces)


def blocks(items: Iterable[tuple], words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks of about so many words, one block at a time."""
    held, n = [], 0
    for item in items:
        size = len(_words(item[1] or "")) + len(_words(item[2] or ""))
        if held and n + size > words:
            yield make_block(held)
            held, n = [], 0
        held.append(item)
        n += size
    if held:
        yield make_block(held)


def encode(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n_words, and the places and numbers of the words in the vocabulary, as int32 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast({w.encode(): t for w, t in block.vocabulary.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, absent = shared.value.get, repeat(-1)
        for batch in batches:
            n, at, term = [], [], []
            for x in batch.column(1):
                words = word_bytes((x.as_py() or "").lower())
                t = np.fromiter(map(get, words, absent), np.int32, len(words))
                where = np.flatnonzero(t >= 0)
                n.append(len(words))
                at.append(where.astype(np.int32).tobytes())
                term.append(t[where].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(at, pa.binary()), pa.array(term, pa.binary())],
                ["doc_id", "n_words", "at", "term"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words int, at binary, term binary"
    )


def _passages(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """Passage number in the batch and term of every encoded word, and how many passages there are (cells, not overlapping)."""
    owner, terms, base = [], [], 0
    for n, at, term in zip(batch.column("n_words").to_pylist(), batch.column("at"), batch.column("term"), strict=True):
        where = np.frombuffer(at.as_py(), np.int32)
        owner.append(where // CELL + base)
        terms.append(np.frombuffer(term.as_py(), np.int32))
        base += -(-n // CELL)
    return np.concatenate(owner or [np.zeros(0, np.int64)]).astype(np.int64), np.concatenate(terms or [np.zeros(0, np.int32)]), base


def document_frequencies(encoded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            owner, terms, n = _passages(batch)
            found = np.sort(owner * size + terms)
            found = found[np.flatnonzero(np.diff(found, prepend=-1))]
            counts[:size] += np.bincount(found % size, minlength=size)
            counts[size] += n
        kept = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(counts[kept])], ["term", "n"])

    out = np.zeros(size + 1, np.int64)
    for term, n in encoded.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # one row a term
        out[term] = n
    return out[:size], int(out[size])


def gram_product(encoded: DataFrame, weight: np.ndarray, test: np.ndarray) -> np.ndarray:
    """A'A x test for the TF-IDF matrix A of all passages, rows of unit length; summed over tasks in a tree."""
    shared = encoded.sparkSession.sparkContext.broadcast((weight.astype(np.float32), test.astype(np.float32)))
    size, width = test.shape
    narrow = np.uint16 if size < 1 << 16 else np.int32  # sorted by radix if narrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, test = shared.value
        out = np.zeros((size, width), np.float32)
        for batch in batches:
            owner, terms, n = _passages(batch)
            use = weight[terms] > 0
            cell = np.sort(owner[use] * size + terms[use])
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            tf = np.diff(np.append(first, len(cell)))
            owner, terms = np.divmod(cell[first], size)
            value = (1 + np.log(tf)).astype(np.float32) * weight[terms]
            norm = np.sqrt(np.bincount(owner, value**2, n)).astype(np.float32)
            value /= norm[owner]
            borders = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
            cuts = np.unique(np.append(borders[:: GRAM_PASSAGES], len(owner)))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # whole passages at once
                o, t, v = owner[a:b], terms[a:b].astype(narrow), value[a:b]
                starts = np.flatnonzero(np.diff(o, prepend=-1))
                y = segment_sums(test, t, starts, v)
                at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(o))))
                order = np.argsort(t, kind="stable")
                t = t[order].astype(np.int64)
                first = np.flatnonzero(np.diff(t, prepend=-1))
                out[t[first]] += segment_sums(y, at[order], first, v[order])
        part = TaskContext.get().partitionId()
        rows = [out[i : i + TERMS_PER_ROW].tobytes() for i in range(0, size, TERMS_PER_ROW)]
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array(rows, pa.binary())], ["block", "part", "z"]
        )

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["z"]).astype(np.float32)
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "z": [z.tobytes()]})

    parts, schema = encoded.rdd.getNumPartitions(), "block int, part int, z binary"
    sums = encoded.mapInArrow(run, schema)
    while parts > 1:
        sums = sums.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("block", "part").applyInPandas(add, schema)
        parts = -(-parts // FAN_IN)
    out = np.zeros((size, width))
    for block, _, z in sums.collect():  # the block's vocabulary x width
        part = np.frombuffer(z, np.float32).reshape(-1, width)
        out[block * TERMS_PER_ROW : block * TERMS_PER_ROW + len(part)] = part
    return out


def latent_space(encoded: DataFrame, weight: np.ndarray) -> np.ndarray:
    """Right singular vectors (terms x RANK at most) of the corpus's TF-IDF matrix, by a one-pass randomised SVD."""
    size = len(weight)
    width = min(size, RANK + OVERSAMPLE)
    test = np.random.default_rng(7).standard_normal((size, width))
    z = gram_product(encoded, weight, test)
    values, vectors = np.linalg.eigh((test.T @ z + z.T @ test) / 2)
    keep = values > max(values.max(), 0) * 1e-6 if len(values) else np.zeros(0, bool)
    if not keep.any():
        return np.zeros((size, 1), np.float32)
    u, _, _ = np.linalg.svd(z @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u[:, :RANK].astype(np.float32)


def common_subsequence(masks: dict[int, int], terms: list[int], length: int) -> int:
    """Length of the longest common subsequence, all columns of the table at once in one integer."""
    full = (1 << length) - 1
    row = full
    for t in terms:
        hit = masks.get(t)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return length - row.bit_count()


def signatures(terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Runs of terms as sets of 64 x SIGNED bits (SIGNED x n); a bit that a piece has and a window has not is a word it lacks."""
    bit = np.uint64(1) << (terms & 63).astype(np.uint64)
    word = terms >> 6 & SIGNED - 1
    return np.stack([np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), starts) for k in range(SIGNED)])


def runs(terms: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the runs of so many terms that begin at each place."""
    n = max(0, len(terms) - words + 1)
    out = np.zeros(n, np.uint64)
    for j in range(words):
        out = (out + terms[j : j + n].astype(np.uint64) + np.uint64(1)) * MIX
    return out


def search(encoded: DataFrame, block: Block, idf: np.ndarray, weight: np.ndarray, space: np.ndarray) -> DataFrame:
    """A row of SCHEMA for each document and item it holds; ``weight`` is ``idf``, but 0 for common terms."""
    for p in block.pieces:
        if not p.answer:
            p.answer = sorted(set(p.terms), key=lambda t: (-idf[t], t))[:ANSWER_TERMS]
    project = (weight[:, None] * space).astype(np.float32)
    empty = np.zeros((0, project.shape[1]), np.float32)
    queries = np.stack([project[p.terms].sum(axis=0) for p in block.pieces]) if block.pieces else empty
    length = np.linalg.norm(queries, axis=1)
    queries /= np.maximum(length[:, None], 1e-12)
    reach = np.maximum(REACH * length, 1e-9).astype(np.float32)
    words = np.array([len(p.terms) for p in block.pieces], np.int64)
    terms = np.array([t for p in block.pieces for t in p.terms], np.int64)
    signed = signatures(terms, np.cumsum(words) - words) if len(words) else np.zeros((SIGNED, 0), np.uint64)
    spare = np.floor((1 - LIKELY) * words + 1e-9).astype(np.int64)  # words that a likely piece may lack
    common = np.array([sum(weight[t] > 0 for t in p.terms) for p in block.pieces], np.int64) <= spare
    common &= words >= LEAST_WORDS
    reach[common | (words < LEAST_WORDS)] = np.inf  # common ones are compared with every window, short ones sought whole
    sought: dict[int, list[tuple]] = {}  # by its words: hash, place in the piece and piece of each other piece's rarest run
    for q in np.flatnonzero(~common).tolist():
        own = np.array(block.pieces[q].terms)
        n = min(len(own), LEAST_WORDS)
        place = int(np.argmax(np.convolve(idf[own], np.ones(n), "valid")))
        sought.setdefault(n, []).append((int(runs(own, n)[place]), place, q))
    anchors = {n: [np.array(x, kind) for x, kind in zip(zip(*sorted(found), strict=True), (np.uint64, np.int64, np.int64), strict=True)] for n, found in sought.items()}
    shared = encoded.sparkSession.sparkContext.broadcast(
        (block, weight > 0, project, queries.T.copy(), reach, signed, spare, np.flatnonzero(common), anchors)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weighty, project, queries, reach, signed, spare, common_pieces, anchors = shared.value
        shift = np.uint64(64 - RUN_BITS)
        maybe = {n: np.zeros(1 << RUN_BITS, bool) for n in anchors}
        for n, (hashes, _, _) in anchors.items():
            maybe[n][hashes >> shift] = True
        ids, pieces, width = block.ids, block.pieces, project.shape[1]
        names, types = [x.split()[0] for x in SCHEMA.split(", ")], [pa.int64()] * 2 + [pa.float64(), pa.int32(), pa.float64(), pa.float64()]

        def anchored(at: np.ndarray, term: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
            """First cells of the windows, and pieces, where a sought run of this length stands without gaps."""
            hashes, places, whose = anchors[length]
            hashed = runs(term, length)
            hit = np.flatnonzero(maybe[length][hashed >> shift])
            hit = hit[at[hit + length - 1] - at[hit] == length - 1]
            low, high = (np.searchsorted(hashes, hashed[hit], side=side) for side in ("left", "right"))
            n = high - low
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return (np.repeat(at[hit], n) - places[which]) // CELL, whose[which]

        def found_in(at: np.ndarray, term: np.ndarray, cells: int, blank: np.ndarray) -> Iterator[tuple]:
            """(window's first cell, item, (coverage, common words, cosine, answer share)) over a chunk of texts."""
            owner = at // CELL
            heavy = weighty[term]
            o, t = owner[heavy], term[heavy]
            held = np.bincount(o, minlength=cells + 1)
            enough = held[:-1] + held[1:] >= LEAST_TERMS
            enough[blank] = False
            windows = np.flatnonzero(enough)
            vectors = np.zeros((cells + 1, width), np.float32)
            if len(o):
                starts = np.flatnonzero(np.diff(o, prepend=-1))
                vectors[o[starts]] = segment_sums(project, t, starts)
            edges = np.searchsorted(owner, np.arange(cells + 2))
            held = np.zeros((SIGNED, cells + 1), np.uint64)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(starts):
                held[:, owner[starts]] = signatures(term, starts)
            lacking = ~(held[:, :-1] | held[:, 1:])

            def near_enough(w: np.ndarray, q: np.ndarray) -> np.ndarray:
                """Whether windows and pieces, of shapes that go together, differ in few enough words."""
                return sum(np.bitwise_count(signed[k][q] & lacking[k][w]) for k in range(SIGNED)) <= spare[q]

            def cosines(w: np.ndarray, q: np.ndarray) -> np.ndarray:
                v = vectors[w] + vectors[w + 1]
                return (v * queries[:, q].T).sum(axis=1) / np.maximum(np.linalg.norm(v, axis=1), 1e-12)

            def verified(w: np.ndarray, q: np.ndarray, cosine: np.ndarray) -> Iterator[tuple]:
                for start, k, c in zip(w.tolist(), q.tolist(), cosine.tolist(), strict=True):
                    piece = pieces[k]
                    inside = term[edges[start] : edges[start + 2]].tolist()
                    words = len(piece.terms)
                    if len(inside) < LIKELY * words:
                        continue
                    common = common_subsequence(piece.masks, inside, words)
                    if common < LIKELY * words:
                        continue
                    answer = len(set(inside).intersection(piece.answer)) / len(piece.answer)
                    if common >= SURE * words or answer >= ANSWER_SHARE:
                        yield start, piece.item, (common / words, common, c, answer)

            seen = [np.zeros(0, np.int64)]
            every = np.arange(len(pieces))[None]
            for a in range(0, len(windows), TILE):
                w = windows[a : a + TILE]
                v = vectors[w] + vectors[w + 1]
                dots, norms = v @ queries, np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                i, q = np.nonzero((dots >= reach) & (dots >= COSINE * norms) & near_enough(w[:, None], every))
                seen.append(w[i] * len(pieces) + q)
                yield from verified(w[i], q, dots[i, q] / norms[i, 0])
            alive = np.ones(cells, bool)
            alive[blank] = False
            for length in anchors:
                begin, q = anchored(at, term, length)
                inside = begin >= 0
                begin, q = begin[inside], q[inside]
                pairs = begin * len(pieces) + q
                pairs = np.setdiff1d(pairs[alive[begin]], np.concatenate(seen))
                w, q = np.divmod(pairs, len(pieces))
                near = np.flatnonzero(near_enough(w, q))
                yield from verified(w[near], q[near], cosines(w[near], q[near]))
            filled = np.diff(edges) > 0
            alive &= filled[:-1] | filled[1:]
            windows = np.flatnonzero(alive)
            for k in common_pieces.tolist():
                w = windows[near_enough(windows, np.array([k]))]
                yield from verified(w, np.full(len(w), k), cosines(w, np.full(len(w), k)))

        for batch in batches:
            rows: list[tuple] = []
            chunk: list[tuple] = []  # place, counted from the first cell, and term
            docs: list[int | None] = []
            first = [0]  # first cell of each text; an empty cell ends each, so that no window spans two texts

            def flush() -> None:
                if docs and pieces:
                    at, term = (np.concatenate(x) for x in zip(*chunk, strict=True))
                    best: dict[tuple, tuple] = {}
                    for start, item, new in found_in(at, term, first[-1], np.array(first[1:]) - 1):
                        key = (int(np.searchsorted(first, start, side="right")) - 1, item)
                        best[key] = max(best.get(key, new), new)
                    rows.extend((docs[d], ids[k], c, n, g, a) for (d, k), (g, n, c, a) in sorted(best.items()))
                docs.clear()
                chunk.clear()
                first[:] = [0]

            for doc, n, at, term in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at:
                    chunk.append((np.frombuffer(at, np.int32).astype(np.int64) + first[-1] * CELL, np.frombuffer(term, np.int32)))
                    docs.append(doc)
                    first.append(first[-1] + -(-n // CELL) + 1)
                    if first[-1] >= CHUNK_CELLS:
                        flush()
            flush()
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return encoded.mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row of SCHEMA for each row of ``docs`` and each benchmark item that it holds, exactly or paraphrased."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).orderBy("item_id", "text")
    out = None
    for block in blocks(tuple(r) for r in items.toLocalIterator()):
        encoded = materialise(encode(docs, block), "encoded")
        size = max(1, len(block.vocabulary))
        df, total = document_frequencies(encoded, size)
        idf = np.log((total + 1) / (df + 1)) ** 2 + 0.1  # squared, so that the rare terms of a short piece outweigh its surroundings
        weight = np.where(df > STOP_SHARE * total, 0.0, idf)
        found = search(encoded, block, idf, weight, latent_space(encoded, weight))
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def drop_leaks(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df`` that hold no benchmark item."""
    found = materialise(leaks(df, benchmark).select("doc_id").distinct(), "leaks")
    return df.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES: dict[str, str] = {}
