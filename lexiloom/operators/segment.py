"""Sentences, words and model chunks.  One Arrow map each, linear in the text and without a shuffle: offsets come from the row.

Results for odd input: null and blank texts give no rows; texts are cut whole, whatever their length; offsets count code
points; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a sentence: ? or ! unless within the last two characters; a full stop before a space and a capital, hyphen or quote.
END = re.compile(r"""[?!](?=[\s\S]{2})|\.(?= [A-Z\-"'])""")
TOKEN = r"([0-9a-zA-Z]+|[^0-9a-zA-Z])"
LONG_TITLE, LONG_SENTENCE, CUT, SHORT_REST = 50, 100, 200, 100
LONG_WORD, SHOWN = 20, 10
CHUNK_WORDS = 30
#: Bytes of text that are taken apart at once; a longer text is taken alone.
PART_BYTES = 1 << 20

_tokens = re.compile(r"[0-9a-zA-Z]+|[^0-9a-zA-Z]")
_words = re.compile(r"[0-9a-zA-Z]+|[^0-9a-zA-Z ]")
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, or single other characters; concatenated they are the text again."""
    return F.regexp_extract_all(c, F.lit(TOKEN), 1)


def cut_long(sentence: str) -> list[str]:
    """A sentence of over LONG_SENTENCE words in pieces of CUT raw tokens, until the rest has under SHORT_REST words."""
    if len(sentence) <= LONG_SENTENCE:
        return [sentence]
    starts = [m.start() for m in _tokens.finditer(sentence)]
    counted = np.cumsum([0, *(sentence[i] != " " for i in starts)])  # words before each token, and all
    if counted[-1] <= LONG_SENTENCE:
        return [sentence]
    at = range(CUT, len(starts) + CUT, CUT)  # the rest behind each cut
    last = next(i for i in at if counted[-1] - counted[min(i, len(starts))] < SHORT_REST)
    cuts = [*(starts[i] for i in range(0, min(last, len(starts)), CUT)), starts[last] if last < len(starts) else len(sentence)]
    return [sentence[a:b] for a, b in zip(cuts, [*cuts[1:], len(sentence)], strict=True) if a < b]


def split_sentences(text: str) -> list[str]:
    """The sentences of a text, long ones in pieces; joined they are the text."""
    cuts = [0, *(m.end() for m in END.finditer(text)), len(text)]
    return [piece for a, b in zip(cuts, cuts[1:], strict=False) if a < b for piece in cut_long(text[a:b])]


def document_parts(title: str | None, abstract: str | None) -> list[str]:
    """All pieces of a document in order.  A short title is one piece; the abstract begins with the space before it."""
    if title is None:
        return split_sentences(abstract or "")
    short = title and sum(1 for _ in _words.finditer(title)) < LONG_TITLE
    head = [title] if short else split_sentences(title)
    return head + (split_sentences(" " + abstract) if abstract else [])


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_idx, text, start from doc_id, title (null: raw text), abstract; blank sentences give no rows.

    A sentence's number counts the blank ones before it; the abstract is split with the space before it, so offsets go on.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, columns in parts(batch):
                owner, number, text, start = [], [], [], []
                for row, title, abstract in zip(rows, *(c.to_pylist() for c in columns[1:]), strict=True):
                    at = 0
                    for i, piece in enumerate(document_parts(title, abstract)):
                        if piece.strip(" "):
                            owner.append(row)
                            number.append(i)
                            text.append(piece)
                            start.append(at)
                        at += len(piece)
                out = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(start, pa.int32())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "sent_idx", "text", "start"])

    return docs.select("doc_id", "title", "abstract").mapInArrow(run, f"doc_id {key}, sent_idx int, text string, start int")


def parts(batch: pa.RecordBatch) -> Iterator[tuple[range, list[pa.Array]]]:
    """Row numbers and columns of runs of rows of at most PART_BYTES bytes, or of one row."""
    first = 0
    while first < len(batch):
        n = len(batch) - first
        while n > 1 and sum(c.slice(first, n).nbytes for c in batch.columns) > PART_BYTES:
            n = -(-n // 2)
        yield range(first, first + n), [c.slice(first, n) for c in batch.columns]
        first += n


def token_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, number within the row, start and length in code points, and string of every word of the texts (no nulls).

    All at once on the bytes: a token begins at each character that does not go on a run of letters and digits.
    """
    texts = pa.concat_arrays([texts])  # offsets from zero
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets.astype(np.int64) - offsets[0]
    points = (data & 0xC0) != 0x80
    goes_on = np.zeros(len(data), bool)
    alnum = _ALNUM[data]
    goes_on[1:] = alnum[1:] & alnum[:-1]
    goes_on[offsets[:-1][np.diff(offsets) > 0]] = False
    begin = np.flatnonzero(points & ~goes_on)
    end = np.append(begin[1:], len(data))
    word = data[begin] != 32
    begin, end = begin[word], end[word]
    count = np.concatenate([[0], np.cumsum(points)])  # code points before each byte
    row = np.searchsorted(offsets, begin, side="right") - 1
    first = np.searchsorted(begin, offsets)[row]
    strings = pa.StringArray.from_buffers(
        len(begin), pa.py_buffer(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)), pa.py_buffer(data[data != 32].tobytes())
    )
    return row, np.arange(len(begin)) - first, count[begin] - count[offsets[row]], count[end] - count[begin], strings


def words(sents: DataFrame) -> DataFrame:
    """doc_id, sent_idx, word_idx, word, shown, start, end; spaces are no words, a long word is shown by its first part."""
    key = sents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, (_, _, text, base) in parts(batch):
                row, number, start, length, word = token_table(text.fill_null(""))
                at = pa.array(row + rows.start)
                start = start + base.to_numpy(zero_copy_only=False)[row].astype(np.int64)
                out = [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), word]
                out += [pa.array(start.astype(np.int32)), pa.array((start + length).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "sent_idx", "word_idx", "word", "start", "end"])

    found = sents.select("doc_id", F.col("sent_idx").cast("int"), "text", F.col("start").cast("int")).mapInArrow(
        run, f"doc_id {key}, sent_idx int, word_idx int, word string, start int, end int"
    )
    shown = F.when(F.length("word") > LONG_WORD, F.substring("word", 1, SHOWN)).otherwise(F.col("word"))
    return found.select("doc_id", "sent_idx", "word_idx", "word", shown.alias("shown"), "start", "end")


def chunks(sents: DataFrame) -> DataFrame:
    """Model examples doc_id, sent_idx, chunk, words of sentences: runs of CHUNK_WORDS shown words, in order.

    No example reaches over a sentence, so they are cut where the sentence lies and nothing is shuffled.
    """
    key = sents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, (_, _, text) in parts(batch):
                row, number, _, _, word = token_table(text.fill_null(""))
                begin = np.flatnonzero(number % CHUNK_WORDS == 0)
                long = pc.greater(pc.utf8_length(word), LONG_WORD)
                shown = pc.if_else(long, pc.utf8_slice_codeunits(word, 0, SHOWN), word)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(word)).astype(np.int32)), shown)
                at = pa.array(row[begin] + rows.start)
                out = [batch.column(0).take(at), batch.column(1).take(at), pa.array((number[begin] // CHUNK_WORDS).astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "sent_idx", "chunk", "words"])

    asked = sents.select("doc_id", F.col("sent_idx").cast("int"), "text")
    return asked.mapInArrow(run, f"doc_id {key}, sent_idx int, chunk int, words array<string>")
