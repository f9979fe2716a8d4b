"""Toxicity: a counterfactually regularised linear classifier over hashed words and word beginnings.

Training takes a bounded, documented sample of labelled rows (POSITIVES and NEGATIVES, the first by a hash of
their ids).  Features are chosen by chi-square over the sample; a logistic regression is fitted on the driver
with an extra penalty on the score change of counterfactual pairs: sentences of the sample whose identity terms
are swapped for others of their group, and for none; to sentences that name no group, as most do, neutral mentions
are added, and swapped.  The swap for another makes groups alike, the swap for none keeps them from being signs
all alike, so neutral mentions of a group do not move the score.  Scoring is a map over whole texts.

Results for odd input: null and empty texts get the score of a text without any feature; texts are scored whole;
repeated rows are scored one by one; a null doc_id is never held out nor used for training; several labels of one
document count as toxic if one says so; without labels of both kinds every score is the share of toxic labels (0
if there are none).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.common import materialise, table, texts

#: The bound of the training sample, in labelled rows.
POSITIVES, NEGATIVES = 4096, 8192
#: Features kept, and the least sampled documents that hold one.
FEATURES, LEAST_DOCUMENTS = 4096, 3
#: Least chi-square statistic of a feature (p = 0.001 of one degree of freedom; see ``cross_validate``), and the penalty's weight.
LEAST_CHI, PENALTY = 10.83, 5.0
THRESHOLD = 0.3
BITS = 22
PREFIXES = (4, 5, 6, 7)
#: Terms of a group stand for each other in counterfactual sentences.
IDENTITY = [
    x.split()
    for x in (
        "woman man girl boy female male transgender nonbinary",
        "women men girls boys females males",
        "christian muslim jewish hindu buddhist atheist sikh catholic",
        "christians muslims jews hindus buddhists atheists sikhs catholics",
        "gay straight lesbian bisexual queer heterosexual",
        "black white asian latino african european american indian arab",
        "german french spanish english mexican chinese russian turkish",
        "old young elderly teenage deaf blind disabled",
        "frau mann mädchen junge", "christen muslime juden hindus", "schwarze weiße deutsche franzosen türken",
        "femme homme fille garçon", "chrétiens musulmans juifs hindous", "noirs blancs français allemands arabes",
        "mujer hombre chica chico", "cristianos musulmanes judíos hindúes", "negros blancos españoles alemanes árabes",
    )
]
_NEXT = {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}
_TERM = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")\b")

_P = np.uint64(0x100000001B3)
_INV = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_CHUNK = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse; grown to the longest chunk seen."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, _CHUNK)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, p)), dtype=np.uint64) for p in (_P, _INV)]
    return _POWERS[0], _POWERS[1]


def hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of every word in lower-cased UTF-8: where it starts, and the hashes of the whole and of its beginnings.

    A prefix sum of byte x base**place gives the hash of any stretch by one difference, without a loop.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _LETTER[raw]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * power[: len(raw)], out=total[1:])
        out = np.empty((len(PREFIXES) + 1, len(start)), np.uint32)
        for k, n in enumerate((None, *PREFIXES)):
            to = end if n is None else np.minimum(start + n, end)
            h = (total[to] - total[start]) * inverse[start] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h ^= h >> np.uint64(32)
            out[k] = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            if n is not None:  # a word no longer than the beginning is told by its whole hash
                out[k][start + n >= end] = out[0][start + n >= end]
    return start, out


def features(text: str) -> np.ndarray:
    """The distinct hashed features of one text."""
    return np.unique(hashes(text.lower().encode())[1])


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by the next of its group; None if there is none."""
    out, n = _TERM.subn(lambda m: _NEXT[m[0]], text)
    return out if n else None


def bare(text: str) -> str:
    """The text without its identity terms."""
    return _TERM.sub(" ", text)


def identity_features() -> np.ndarray:
    return np.unique(np.concatenate([features(t) for t in _NEXT]))


@dataclass
class Model:
    index: np.ndarray  # feature hashes, ascending
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def fit(
    rows: list[np.ndarray], labels: np.ndarray, index: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]],
    penalty: float = PENALTY, l2: float = 1e-4, steps: int = 300,
) -> Model:
    """Logistic regression (Adam, whole batch) with ``penalty`` x mean squared score change over ``pairs``.

    ``rows`` and ``pairs`` hold places in ``index``.  Classes weigh alike in the loss up to a factor of 3.
    """
    n, d = len(rows), len(index)
    share = float(labels.mean()) if n else 0.0
    if not 0 < share < 1:
        return Model(index, np.zeros(d, np.float32), 8.0 if share == 1 else -8.0)
    size = np.array([len(r) for r in rows])
    owner, place = np.repeat(np.arange(n), size), np.concatenate(rows).astype(np.int64)
    po = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    pp = np.concatenate([x for p in pairs for x in p]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    ps = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b in pairs]) if pairs else np.zeros(0)
    weight = np.where(labels == 1, min(3.0, 0.5 / share), 1.0)
    w, b = np.zeros(d), float(np.log(share / (1 - share)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(owner, w[place], n)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        gw = np.bincount(place, g[owner], d) + 2 * l2 * w
        if pairs:
            change = np.bincount(po, ps * w[pp], len(pairs))
            gw += 2 * penalty * np.bincount(pp, ps * change[po], d) / len(pairs)
        grad = np.append(gw, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(index, w.astype(np.float32), float(b))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of at most POSITIVES + NEGATIVES labelled rows outside the held-out part."""
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    part = lambda x, n: one.where(x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return part("toxic = 1", POSITIVES).unionByName(part("toxic <> 1", NEGATIVES))


def train(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY, least_chi: float = LEAST_CHI) -> Model:
    """Fit on the bounded sample.  The driver receives FEATURES hashes and, of each sampled row, only which it holds."""

    names = ["toxic", "features", "gone", "come", "alone"]  # alone: what only the identity terms, or the added one, bring

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.int32())
        for batch in batches:
            found = []
            for value in batch.column(1):
                text = (value.as_py() or "").lower()
                mine, other = features(text), swapped(text)
                if other is None:  # a neutral mention is added, and swapped for another
                    pick = crc32(text.encode())
                    group = IDENTITY[pick % len(IDENTITY)]
                    term = group[pick // len(IDENTITY) % len(group)]
                    gone, come = (np.setdiff1d(features(x), mine) for x in (term, _NEXT[term]))
                    alone = gone
                else:
                    new = features(other)
                    gone, come = np.setdiff1d(mine, new), np.setdiff1d(new, mine)
                    alone = np.setdiff1d(mine, features(bare(text)))
                found.append((mine, gone, come, alone))
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), kinds) for c in columns)], names)

    chosen = sample(labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("toxic", "text").mapInArrow(hashed, f"toxic int, {', '.join(f'{c} array<int>' for c in names[1:])}")
    rows = materialise(rows, "toxicity-sample")
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = total.get(1, 0), sum(n for k, n in total.items() if k != 1)
    always = identity_features()
    if not pos or not neg:
        return fit([np.zeros(0, np.int64)] * (pos + neg), np.array([1.0] * pos + [0.0] * neg), always, [])
    a, b = F.col("pos"), F.col("neg")
    held = (a + b) / (pos + neg)
    chi = (a / pos - b / neg) ** 2 / (held * (1 - held) + 1e-9) * (pos * neg / (pos + neg))
    best = (
        rows.select("toxic", F.explode("features").alias("f")).groupBy("f")
        .agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") != 1).alias("neg"))
        .where((a + b >= LEAST_DOCUMENTS) & (chi >= least_chi)).orderBy(chi.desc(), "f").limit(FEATURES).select("f")
    )
    index = np.union1d(best.toPandas()["f"].to_numpy(np.int64), always)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for column in batch.columns[1:]:
                found = []
                for x in column:
                    f = np.asarray(x.as_py(), np.int64)
                    at = np.minimum(np.searchsorted(index, f), len(index) - 1)
                    found.append(at[index[at] == f].astype(np.int32))
                out.append(pa.array(found, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names)

    data: pd.DataFrame = rows.mapInArrow(located, rows.schema).toPandas()
    pairs = [(a, b) for a, b in zip(data["gone"], data["come"], strict=True) if len(a) or len(b)]
    pairs += [(a, a[:0]) for a in data["alone"] if len(a)]
    return fit(list(data["features"]), (data["toxic"] == 1).to_numpy(float), index, pairs, penalty)


def score(df: DataFrame, model: Model) -> DataFrame:
    """The columns of ``df`` (with text) and the score of every row; a map over rows, nothing is shuffled."""
    names = [c for c in df.columns if c != "score"]
    at = names.index("text")
    shared = df.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Model(*shared.value)
        dense = use.dense()
        for batch in batches:
            sums = np.full(len(batch), use.bias)
            texts: list[bytes] = []
            first = held = 0

            def flush() -> None:
                nonlocal first, held
                if texts:
                    ends = np.cumsum([len(t) + 1 for t in texts])
                    start, found = hashes(b" ".join(texts))
                    doc = np.searchsorted(ends, start, side="right")
                    hit = dense[found] != 0
                    key = np.unique(np.broadcast_to(doc, found.shape)[hit].astype(np.int64) << BITS | found[hit])
                    sums[first : first + len(texts)] += np.bincount(key >> BITS, dense[key & (1 << BITS) - 1], len(texts))
                first, held = first + len(texts), 0
                texts.clear()

            for x in batch.column(at):
                texts.append((x.as_py() or "").lower().encode())
                held += len(texts[-1]) + 1
                if held >= _CHUNK // 2:
                    flush()
            flush()
            found = pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "score"])

    rows = df.select(*[F.col(f"`{c}`") for c in names])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def cross_validate(docs: DataFrame, labels: DataFrame, settings: list[float], folds: int = 3) -> dict[float, tuple[float, int, int]]:
    """Of each least chi-square statistic: log loss a row, toxic rows missed and clean rows rejected, summed over folds of the
    training part; held-out rows take no part."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds))
    mine = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).withColumn("fold", fold)
    out = {}
    for least in settings:
        loss = n = missed = rejected = 0
        for k in range(folds):
            model = train(docs, mine.where(F.col("fold") != k).drop("fold"), least_chi=least)
            own = mine.where(F.col("fold") == k).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
            scored = score(docs.select("doc_id", "text").join(own, "doc_id"), model)
            p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.when(F.col("toxic") == 1, F.col("score")).otherwise(1 - F.col("score"))))
            high = F.col("score") >= THRESHOLD
            r = scored.agg(F.sum(-F.log(p)), F.count("*"), F.count_if((F.col("toxic") == 1) & ~high), F.count_if((F.col("toxic") != 1) & high)).first()
            loss, n, missed, rejected = loss + (r[0] or 0), n + r[1], missed + r[2], rejected + r[3]
        out[least] = (loss / max(n, 1), missed, rejected)
    return out


def with_mentions(df: DataFrame) -> DataFrame:
    """The rows (text, ...) with a neutral mention of a group in front, each of a term that follows from the text."""
    terms = F.lit(sorted(_NEXT))
    own = F.get(terms, F.pmod(F.xxhash64("text"), F.lit(len(_NEXT))).cast("int"))
    return df.withColumn("text", F.concat(own, F.lit(" "), F.coalesce("text", F.lit(""))))


def keep_clean(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` that score under the threshold."""
    return score(df, train(df, labels)).where(F.col("score") < THRESHOLD).drop("score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
