"""Plug-ins by entity type: token taggers, normalizers, pattern taggers, and models that a Python worker loads once.

A token tagger makes tagged words of sentences, a normalizer adds ``ids`` to the mentions of its type, a pattern tagger finds
mentions with ids in whole texts.  ``model_tagger`` makes a token tagger of a model for each type.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import segment, subword, tagging

#: sentences (doc_id, sent_idx, text, start) -> doc_id, etype, sent_idx, word_idx, word, start, end, tag, p; the words of a sentence and
#: type follow one another within a partition, as they do where sentences are mapped
TokenTagger = Callable[[DataFrame], DataFrame]
#: mentions (doc_id, etype, ordinal, start, end, mention, ...) of one type -> the same with ids (array of strings)
EntityNormalizer = Callable[[DataFrame], DataFrame]
#: texts (doc_id, content) -> doc_id, ordinal, start, end, mention, ids
PatternTagger = Callable[[DataFrame], DataFrame]
#: words of examples -> for each example a row of class scores (log-probabilities, seven classes) a word
Model = Callable[[list[list[str]]], list[np.ndarray]]

#: Class scores of a word; ``tagging.LABELS`` names the classes.
CLASSES = 7
#: Words, padding included, that a model gets at once.
BATCH_WORDS = 64 * segment.CHUNK_WORDS
#: Pieces of a batch are padded to a multiple of this.
WIDTH = 8

_models: dict = {}
_lock = threading.RLock()


def held(key: str, load: Callable[[], object]) -> object:
    """What ``load`` gives, loaded once in this Python process and kept for later batches and tasks."""
    with _lock:
        if key not in _models:
            _models[key] = load()
        return _models[key]


@dataclass
class Registry:
    """The plug-ins of a plan.  Types without a normalizer of their own keep unknown ids."""

    tagger: TokenTagger
    normalizers: dict[str, EntityNormalizer] = field(default_factory=dict)
    patterns: dict[str, PatternTagger] = field(default_factory=dict)


def tag_head(scores: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Tags and confidences of rows of class scores: the class of the highest score, and its softmax value."""
    tags, p = _tag_arrays(scores)
    return tags.tolist(), p


def _tag_arrays(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = scores.argmax(axis=1)
    p = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
    return np.array([tagging.LABELS.get(c, "O") for c in range(scores.shape[1])])[best], p


def sentence_tagger(tag: Callable[[str, np.ndarray, pa.Array], tuple[np.ndarray, list[str], np.ndarray]], etypes: Sequence[str] = tagging.RIVALS) -> TokenTagger:
    """A token tagger of ``tag(etype, numbers, words)``, which gets each word and its number within its sentence and gives the
    places of the words that are tagged, their tags and their confidences.

    Sentences are mapped batch by batch, without a shuffle; words come back with offsets.  Words tagged O are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "etype", "sent_idx", "word_idx", "word", "start", "end", "tag", "p"]
        for batch in batches:
            for rows, (_, number, text, base) in segment.parts(batch):
                row, nth, start, length, word = segment.token_table(text.fill_null(""))
                start = start + np.asarray(base.to_pylist(), np.int64)[row]
                for etype in etypes:
                    kept, tags, p = tag(etype, nth, word)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(row[kept] + rows.start)), pa.array([etype] * len(kept), pa.string()), number.take(pa.array(row[kept])),
                            pa.array(nth[kept], pa.int32()), word.take(pa.array(kept)), pa.array(start[kept], pa.int32()),
                            pa.array((start + length)[kept], pa.int32()), pa.array(tags, pa.string()), pa.array(p, pa.float64()),
                        ],
                        names,
                    )

    def tagger(sents: DataFrame) -> DataFrame:
        key = sents.schema["doc_id"].dataType.simpleString()
        rows = sents.select("doc_id", F.col("sent_idx").cast("int"), "text", F.col("start").cast("int"))
        return rows.mapInArrow(run, f"doc_id {key}, etype string, sent_idx int, word_idx int, word string, start int, end int, tag string, p double")

    return tagger


def length_batches(lengths: Sequence[int], budget: int = BATCH_WORDS) -> list[np.ndarray]:
    """Places of examples in batches of like lengths: padded to its longest, a batch has ``budget`` words at most, or one example."""
    own = np.asarray(lengths, np.int64)
    order, out, first = np.argsort(own, kind="stable"), [], 0
    ascending = own[order].tolist()
    for i in range(1, len(order) + 1):
        if i == len(order) or (i - first + 1) * ascending[i] > budget:
            out.append(order[first:i])
            first = i
    return out


def padding_share(lengths: Sequence[int], batches: Sequence[np.ndarray]) -> float:
    """Share of padding in all that the batches hold."""
    own = np.asarray(lengths, np.int64)
    held_words = sum(len(b) * int(own[b].max()) for b in batches)
    return 1 - own.sum() / held_words if held_words else 0.0


def model_tagger(load: Callable[[str], Model], etypes: Sequence[str] = tagging.RIVALS, name: str = "tagger") -> TokenTagger:
    """A token tagger of one model a type; ``load(etype)`` runs once in each Python worker.

    A sentence's words go to the model in runs of CHUNK_WORDS, runs of like lengths of all sentences at hand together; their order is
    restored behind it.
    """

    def tag(etype: str, nth: np.ndarray, word: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        model = held(f"{name}/{etype}", lambda: load(etype))
        cuts = np.append(np.flatnonzero(nth % segment.CHUNK_WORDS == 0), len(word))
        batches = length_batches(np.diff(cuts))
        if isinstance(model, SessionModel):
            scores, laid = np.zeros((len(word), CLASSES), np.float32), model.lay(word, cuts)
            for batch in batches:
                at, own = model.scores(laid, batch)
                scores[at] = own
        else:
            words, parts = word.to_pylist(), [np.zeros((0, CLASSES))] * (len(cuts) - 1)
            examples = [words[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            for batch in batches:
                for i, x in zip(batch, model([examples[i] for i in batch]), strict=True):
                    parts[i] = x
            scores = np.concatenate(parts) if parts else np.zeros((0, CLASSES))
        tags, p = _tag_arrays(scores)
        kept = np.flatnonzero(tags != "O")
        return kept, tags[kept], p[kept]

    return sentence_tagger(tag, etypes)


class SessionModel:
    """The model that ``session_model`` makes.  ``model_tagger`` gives it arrays of words, by ``lay`` and ``scores``; called with lists of
    words it is a model like any other."""

    def __init__(self, session: object, encoder: subword.Encoder, length: int) -> None:
        self.session, self.length, self.encoder = session, length, encoder

    def lay(self, words: pa.Array, starts: np.ndarray) -> subword.Laid:
        return self.encoder.lay(words, starts, self.length)

    def scores(self, laid: subword.Laid, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of these examples, which are one batch, and a row of class scores for each."""
        rows = np.asarray(rows, np.int64)
        width = min(self.length, -(-int(laid.kept[rows].max(initial=-2) + 2) // WIDTH) * WIDTH)
        ids, mask = self.encoder.ids_of(laid, rows, width) if len(rows) else np.zeros((2, 0, 0), np.int64)
        out = np.asarray(self.session.run(None, {"input_ids": ids, "input_mask": mask, "segment_ids": np.zeros_like(ids)})[0])
        count = np.diff(laid.starts)[rows]
        at = np.arange(count.sum()) + np.repeat(laid.starts[rows] - np.cumsum(count) + count, count)
        first, found = laid.first[at], np.full((len(at), CLASSES), -1e4, np.float32)
        found[:, 3] = 0  # outside
        known = first >= 0
        found[known] = out[np.repeat(np.arange(len(rows)), count)[known], first[known]]
        return at, found

    def __call__(self, examples: list[list[str]]) -> list[np.ndarray]:
        starts = np.append(0, np.cumsum([len(words) for words in examples])).astype(np.int64)
        laid = self.lay(pa.array([w for words in examples for w in words], pa.string()), starts)
        return np.split(self.scores(laid, np.arange(len(examples)))[1], starts[1:-1]) if examples else []


def session_model(session: object, vocabulary: dict[str, int] | subword.Encoder, length: int = 256, lower: bool = False) -> SessionModel:
    """A model of an inference session (as onnxruntime's, with inputs input_ids, input_mask and segment_ids, and one output of class
    scores a piece): words become pieces, and a word has the scores of its first piece; words behind the cut at ``length`` are outside.

    A batch is padded to its own longest example, up to a multiple of WIDTH.  Models of one encoder, given instead of a vocabulary, cut
    words once for all of them.
    """
    encoder = vocabulary if isinstance(vocabulary, subword.Encoder) else subword.Encoder(vocabulary, lower)
    return SessionModel(session, encoder, length)
