"""Subword tokenisation for neural taggers: basic tokens, greedy longest pieces, vocabulary ids, padded examples.

Vocabularies are given, never trained.  One Arrow map makes examples; the vocabulary is broadcast, VOCABULARY_MOST tokens at most.

Results for odd input: words without any token (control characters, odd blanks) have no pieces and no first piece; words that no
pieces make up, or of over LONGEST characters, are the unknown token; an unknown token or id in a lookup is a KeyError.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexiloom.operators import segment

UNKNOWN, FIRST, LAST, PADDING = "[UNK]", "[CLS]", "[SEP]", "**NULL**"
#: Numbers of labels; X marks the pieces of a word that follow its first one.
LABEL_IDS = {"B": 1, "I": 2, "O": 3, "X": 4, FIRST: 5, LAST: 6}
LONGEST, LENGTH = 200, 256
#: Characters of a token whose pieces are looked up length by length; longer ones are cut in one pass.
SHORT = 16
#: Tokens of a vocabulary that may be broadcast.
VOCABULARY_MOST = 2_000_000
#: Words whose pieces a worker remembers; the memory is emptied when it is full, which changes no result.
REMEMBERED = 200_000
#: Examples that are made at once.
BATCH_ROWS = 512
#: Code points of Chinese characters, each of which is a token.
CJK = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)


class _Cleaned(dict):
    """For ``str.translate``: control characters go, blanks are spaces, Chinese characters stand alone."""

    def __missing__(self, point: int) -> str:
        kind = unicodedata.category(chr(point))
        if point in (9, 10, 13) or kind == "Zs":
            out = " "
        elif point in (0, 0xFFFD) or kind in ("Cc", "Cf"):
            out = ""
        else:
            out = f" {chr(point)} " if any(a <= point <= b for a, b in CJK) else chr(point)
        self[point] = out
        return out


class _Apart(dict):
    """For ``str.translate``: punctuation, and every ASCII sign, stands alone."""

    def __missing__(self, point: int) -> str:
        sign = 33 <= point < 127 and not chr(point).isalnum()
        out = self[point] = f" {chr(point)} " if sign or unicodedata.category(chr(point)).startswith("P") else chr(point)
        return out


_cleaned, _apart = _Cleaned(), _Apart()
#: The encoder of the last vocabulary that this Python worker had, kept for later tasks.
_last: dict[str, Encoder] = {}


def _unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")


def basic_tokens(text: str, lower: bool = False) -> list[str]:
    """Words and single punctuation marks; ``lower`` also removes accents."""
    if text.isascii() and text.isalnum():
        return [text.lower() if lower else text]
    words = text.translate(_cleaned).split()
    return " ".join(_unaccented(w) if lower else w for w in words).translate(_apart).split()


def basic(c: Column, lower: bool = False) -> Column:
    """Basic tokens of a column of texts; Spark has no character classes by property that keep up with ``unicodedata``."""

    @F.arrow_udf(ArrayType(StringType()))
    def made(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.string()))]
        for _, (some,) in segment.parts(pa.RecordBatch.from_arrays([texts], ["text"])):  # Python's strings of a part at a time
            out.append(pa.array([None if t is None else basic_tokens(t, lower) for t in some.to_pylist()], pa.list_(pa.string())))
        return pa.concat_arrays(out)

    return made(c)


def pieces(token: str, vocabulary: dict[str, int], longest: int = LONGEST) -> list[str]:
    """The longest piece of the vocabulary at each place from left to right; pieces inside a word begin with ##."""
    if len(token) > longest:
        return [UNKNOWN]
    out, at = [], 0
    while at < len(token):
        mark = "##" if at else ""
        end = next((e for e in range(len(token), at, -1) if mark + token[at:e] in vocabulary), 0)
        if not end:
            return [UNKNOWN]
        out.append(mark + token[at:end])
        at = end
    return out


class Pieces:
    """``pieces`` of a vocabulary in one pass over a token, whatever its length.

    Two tries hold what can begin a word and what can go on in it.  Each node has a failure link, to the node that stands for the rest
    of its string after some longest pieces, and those pieces, its failure pops.  Where no child goes on, the pops are put out and the
    link is taken; each character is stepped over once, and each pop is a piece of the result.  Tokens of up to SHORT characters are
    looked up plainly, and the tries are made when the first longer one comes.
    """

    def __init__(self, vocabulary: dict[str, int], longest: int = LONGEST, short: int = SHORT) -> None:
        self.vocabulary, self.longest, self.short = vocabulary, longest, short
        #: characters of the longest token, and of the longest one that goes on in a word, without its mark
        self.most = max(map(len, vocabulary), default=0), max((len(t) - 2 for t in vocabulary if t.startswith("##")), default=0)
        self.child: dict[tuple[int, str], int] = {}
        self.link: list[int] = []
        self.pops: list[tuple[str, ...]] = []

    def _grow(self) -> None:
        """Nodes 0 and 1 are the roots: of whole tokens, and of those that go on, without their mark."""
        whole: list[str | None] = [None, None]
        edges: list[list[tuple[str, int]]] = [[], []]
        for token in self.vocabulary:
            for root, string in ((0, token), (1, token[2:] if token.startswith("##") else "")):
                node = root
                for c in string:
                    step = self.child.get((node, c))
                    if step is None:
                        step = self.child[node, c] = len(whole)
                        whole.append(None)
                        edges.append([])
                        edges[node].append((c, step))
                    node = step
                if string:
                    whole[node] = token
        self.link, self.pops = [-1] * len(whole), [()] * len(whole)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for c, to in edges[node]:
                    below.append(to)
                    if whole[to] is not None:
                        self.link[to], self.pops[to] = 1, (whole[to],)
                        continue
                    at, popped = self.link[node], self.pops[node]
                    while at >= 0 and (at, c) not in self.child:
                        popped, at = popped + self.pops[at], self.link[at]
                    if at >= 0:
                        self.link[to], self.pops[to] = self.child[at, c], popped
            level = below

    def _plain(self, token: str) -> list[str]:
        """As ``pieces``, but no piece is tried that is longer than any token."""
        out, at, n, vocabulary = [], 0, len(token), self.vocabulary
        mark, most = "", self.most[0]
        while at < n:
            for end in range(min(n, at + most), at, -1):
                piece = mark + token[at:end]
                if piece in vocabulary:
                    break
            else:
                return [UNKNOWN]
            out.append(piece)
            at, mark, most = end, "##", self.most[1]
        return out

    def __call__(self, token: str) -> list[str]:
        if len(token) > self.longest:
            return [UNKNOWN]
        if len(token) <= self.short:
            return self._plain(token)
        if not self.link:
            self._grow()
        node, out = 0, []
        for c in token:
            while (step := self.child.get((node, c))) is None:
                if self.link[node] < 0:
                    return [UNKNOWN]
                out += self.pops[node]
                node = self.link[node]
            node = step
        while node != 1:
            if self.link[node] < 0:
                return [UNKNOWN]
            out += self.pops[node]
            node = self.link[node]
        return out


def tokenize(text: str, vocabulary: dict[str, int], lower: bool = False) -> list[str]:
    return [p for token in basic_tokens(text, lower) for p in pieces(token, vocabulary)]


def vocabulary_of(lines: Iterable[str]) -> dict[str, int]:
    """Ids by line; of equal tokens the last line counts."""
    return {token: i for i, token in enumerate(lines)}


def to_ids(tokens: Iterable[str], vocabulary: dict[str, int]) -> list[int]:
    return [vocabulary[t] for t in tokens]


def to_tokens(ids: Iterable[int], vocabulary: dict[str, int]) -> list[str]:
    back = {i: t for t, i in vocabulary.items()}
    return [back[i] for i in ids]


@dataclass
class Example:
    """A model's input: all lists but ``first`` have the same length; ``first`` has each word's first piece, -1 if it has none."""

    ids: list[int]
    mask: list[int]
    segments: list[int]
    labels: list[int]
    tokens: list[str]
    first: list[int]


def marked(words: list[str], labels: list[str] | None, found: Callable[[str], list[str]], length: int) -> tuple[list[str], list[str], list[int]]:
    """Pieces between the two marks, cut to ``length``, their labels, and each word's first piece."""
    tokens, marks, first = [], [], []
    for i, word in enumerate(words):
        own = found(word)
        first.append(len(tokens) + 1 if own and len(tokens) < length - 2 else -1)
        tokens += own
        marks += [labels[i] if labels else "O", *["X"] * (len(own) - 1)][: len(own)]
    return [FIRST, *tokens[: length - 2], LAST], [FIRST, *marks[: length - 2], LAST], first


def example(words: list[str], labels: list[str] | None, vocabulary: dict[str, int], length: int = LENGTH, lower: bool = False) -> Example:
    """Pieces of the words between the two marks, cut and padded to ``length``."""
    tokens, marks, first = marked(words, labels, lambda w: tokenize(w, vocabulary, lower), length)
    rest = [0] * (length - len(tokens))
    ids, numbers = to_ids(tokens, vocabulary) + rest, [LABEL_IDS[m] for m in marks] + rest
    return Example(ids, [1] * len(tokens) + rest, [0] * length, numbers, tokens + [PADDING] * len(rest), first)


@dataclass
class Laid:
    """Pieces of examples whose words follow one another.  Example e has the words ``starts[e]`` to ``starts[e + 1]``, and ``kept[e]`` pieces
    from ``base[e]`` on; ``first`` is each word's first piece in its example, the mark counted, -1 if it has none before the cut;
    ``heads`` are the first pieces of the words that have any, ``owners`` these words."""

    starts: np.ndarray
    pieces: np.ndarray
    base: np.ndarray
    kept: np.ndarray
    first: np.ndarray
    heads: np.ndarray
    owners: np.ndarray


class Encoder:
    """``marked`` for arrays of words: each distinct word is cut into pieces once and remembered, the rest is arithmetic on arrays.

    Pieces are numbered by their place in the vocabulary, since several can have one id.
    """

    def __init__(self, vocabulary: dict[str, int], lower: bool = False) -> None:
        self.number, self.lower, self.missing = {t: i for i, t in enumerate(vocabulary)}, lower, len(vocabulary)
        self.ids = np.append(np.fromiter(vocabulary.values(), np.int64, len(vocabulary)), 0)
        self.cut, self.known, self.last = Pieces(self.number), {}, None

    def _new(self, word: str) -> list[int]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        got = self.known[word] = [self.number.get(p, self.missing) for token in basic_tokens(word, self.lower) for p in self.cut(token)]
        return got

    def lay(self, words: pa.Array, starts: np.ndarray, length: int) -> Laid:
        """The pieces of the words, cut to ``length``.  Asked for the same array again, as by models that share an encoder, it gives what it made."""
        if self.last is None or self.last[0] is not words or self.last[1] != length or not np.array_equal(self.last[2].starts, starts):
            self.last = words, length, self._laid(words, starts, length)
        return self.last[2]

    def _laid(self, words: pa.Array, starts: np.ndarray, length: int) -> Laid:
        coded, get = words.dictionary_encode(), self.known.get
        own = [x if (x := get(w)) is not None else self._new(w) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(chain.from_iterable(own), np.int64, int(size.sum()))
        code = coded.indices.to_numpy(zero_copy_only=False)
        n, begin = size[code], (np.cumsum(size) - size)[code]
        before = np.append(0, np.cumsum(n))
        pieces = np.append(flat[np.repeat(begin - before[:-1], n) + np.arange(before[-1])], 0)  # one more, for examples without any
        base, head = before[starts], before[:-1]
        place = head - np.repeat(base[:-1], np.diff(starts))
        kept = np.minimum(np.diff(base), length - 2)
        return Laid(starts, pieces, base[:-1], kept, np.where((n > 0) & (place < length - 2), place + 1, -1), head[n > 0], np.flatnonzero(n))

    def places(self, laid: Laid, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``laid.pieces`` what stands between the marks is, for each row ``width`` - 2 places, and which of them are in use."""
        at = np.arange(width - 2)
        inside = at < laid.kept[rows][:, None]
        return np.minimum(laid.base[rows][:, None] + at, len(laid.pieces) - 1), inside

    def ids_of(self, laid: Laid, rows: np.ndarray, width: int, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the rows, between the two marks, padded to ``width``."""
        at, inside = self.places(laid, rows, width)
        own = laid.pieces[at]
        if (inside & (own == self.missing)).any():
            raise KeyError(UNKNOWN)
        ids = np.zeros((len(rows), width), kind)
        ids[:, 1:-1] = np.where(inside, self.ids[own], 0)
        if len(rows):
            ids[:, 0] = self.ids[self.number[FIRST]]
            ids[np.arange(len(rows)), laid.kept[rows] + 1] = self.ids[self.number[LAST]]
        return ids, (np.arange(width) < laid.kept[rows][:, None] + 2).astype(kind)


def _word_labels(labels: pa.Array, starts: np.ndarray) -> np.ndarray:
    """Label ids of all words, O where an example has no labels, -1 for unknown ones."""
    lengths, words = pc.list_value_length(labels).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(starts)
    if ((lengths > 0) & (lengths < words)).any():
        raise IndexError("an example has fewer labels than words")
    coded = labels.flatten().dictionary_encode()
    numbers = np.array([LABEL_IDS.get(x, -1) for x in coded.dictionary.to_pylist()] + [-1], np.int32)
    own = numbers[coded.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]
    labelled = np.repeat(lengths > 0, words)
    at = np.arange(len(labelled)) + np.repeat(np.cumsum(lengths) - lengths - starts[:-1], words)
    out = np.full(len(labelled), LABEL_IDS["O"], np.int32)
    out[labelled] = own[at[labelled]]
    return out


def examples(
    chunks: DataFrame, vocabulary: DataFrame, length: int = LENGTH, lower: bool = False, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "",
) -> DataFrame:
    """doc_id, sent_idx, chunk, input_ids, input_mask, segment_ids, label_ids (all padded) and tokens (without padding) of every
    chunk (doc_id, sent_idx, chunk, words, and labels if it has that column); vocabulary: token, id.

    A worker remembers the pieces of REMEMBERED words.  ``then``, as a model, makes rows of ``schema`` of each batch where it lies, so that
    the padded arrays don't leave the worker.
    """
    held = vocabulary.select("token", "id").limit(VOCABULARY_MOST + 1).collect()  # made once
    if len(held) > VOCABULARY_MOST:
        raise ValueError(f"a vocabulary has {VOCABULARY_MOST} tokens at most")
    shared = chunks.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in held})
    key, labelled, name = chunks.schema["doc_id"].dataType.simpleString(), "labels" in chunks.columns, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["doc_id", "sent_idx", "chunk", "input_ids", "input_mask", "segment_ids", "label_ids", "tokens"]
        if name not in _last:
            _last.clear()
            _last[name] = Encoder(shared.value, lower)
        encoder = _last[name]
        names = pa.array([*encoder.number, UNKNOWN], pa.string())
        for whole in batches:
            for i in range(0, len(whole), BATCH_ROWS):
                batch = whole.slice(i, BATCH_ROWS)
                n, rows = len(batch), np.arange(len(batch))
                starts = np.append(0, np.cumsum(pc.list_value_length(batch.column(3)).fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
                laid = encoder.lay(batch.column(3).flatten(), starts, length)
                ids, mask = encoder.ids_of(laid, rows, length, np.int32)
                at, inside = encoder.places(laid, rows, length)
                label = np.full(len(laid.pieces), LABEL_IDS["X"], np.int32)
                own = _word_labels(batch.column(4), starts) if labelled else np.full(starts[-1], LABEL_IDS["O"], np.int32)
                label[laid.heads] = own[laid.owners]
                marks = np.zeros((n, length), np.int32)
                marks[:, 1:-1] = np.where(inside, label[at], 0)
                if (marks < 0).any():
                    raise KeyError("unknown label")
                marks[:, 0] = LABEL_IDS[FIRST]
                marks[rows, laid.kept + 1] = LABEL_IDS[LAST]
                ends = np.append(0, np.cumsum(laid.kept + 2)).astype(np.int32)
                token = np.zeros((n, length), np.int64)
                token[:, 1:-1] = laid.pieces[at]
                token[:, 0], token[rows, laid.kept + 1] = encoder.number[FIRST], encoder.number[LAST]
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * length)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(g.reshape(-1))) for g in (ids, mask, np.zeros_like(ids), marks)]
                tokens = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(token[mask > 0])))
                made = pa.RecordBatch.from_arrays([*batch.columns[:3], *lists, tokens], columns)
                yield then(made) if then else made

    arrays = "input_ids array<int>, input_mask array<int>, segment_ids array<int>, label_ids array<int>, tokens array<string>"
    asked = chunks.select("doc_id", "sent_idx", "chunk", "words", *["labels"] * labelled)
    return asked.mapInArrow(run, schema if then else f"doc_id {key}, sent_idx int, chunk int, {arrays}")
