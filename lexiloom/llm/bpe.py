"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token keeps its parts in a doubly linked list.  Every mergeable neighbour pair is filed in the
bucket of its merge rank; a two-level bitmap over the ranks gives the lowest rank with a bucket by
find-first-set, so the lowest rank is found in constant time however long the pre-token is; among the places of one
rank a heap gives the leftmost, in logarithmic time.  Entries whose pair has changed since they were filed are skipped
when they come up.

Results for odd input: null and empty texts have no tokens and decode to empty bytes; texts are encoded
whole, whatever their length; repeated rows are encoded one by one; special-token strings are plain text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import texts

#: Pre-tokens remembered per Python worker in each of two generations: when the younger one is full it becomes the older
#: one, and what is asked for again comes back, so frequent pre-tokens are never merged anew.  This changes no result.
#: The second number is for ``digests``, whose workers hold little else.
CACHE_SIZE, CACHE_SIZE_ALONE = 200_000, 400_000
#: Longer pre-tokens are not remembered, so that the memory stays bounded.
CACHE_LENGTH = 64
#: Code points that ``regex`` knows as letters or numbers and the tokenizer library, which follows
#: an older Unicode version, does not.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8
16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2
1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5
1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Bits of a word of the bitmap.
_BIT = [1 << i for i in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: always merge the pair of lowest rank, the leftmost of equals first."""
    get, bit_of = ranks.get, _BIT
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    stop = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))  # where the part before this one starts
    pair = [get(piece[i : i + 2]) for i in range(n - 1)]  # rank of the part here joined with the next one
    pair.append(None)
    buckets: dict[int, list[int]] = {}
    summary, words = 0, {}
    for i, rank in enumerate(pair):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)  # ascending, so a heap
            else:
                buckets[rank] = [i]
                hi = rank >> 8
                words[hi] = words.get(hi, 0) | bit_of[rank & 255]
                summary |= bit_of[hi] if hi < 256 else 1 << hi
    while summary:
        first = summary & -summary
        hi = first.bit_length() - 1
        word = words[hi]
        lowest = word & -word
        rank = hi << 8 | lowest.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heapq.heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            word ^= lowest
            words[hi] = word
            if not word:
                summary ^= first
        if pair[i] != rank:
            continue  # stale
        mid = stop[i]
        stop[i] = end = stop[mid]
        pair[mid] = None
        if end < n:
            before[end] = i
            pair[i] = new = get(piece[i : stop[end]])
            if new is not None:
                if new in buckets:
                    heapq.heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    hi = new >> 8
                    words[hi] = words.get(hi, 0) | bit_of[new & 255]
                    summary |= bit_of[hi] if hi < 256 else 1 << hi
        else:
            pair[i] = None
        left = before[i]
        if left >= 0:
            pair[left] = new = get(piece[left:end])
            if new is not None:
                if new in buckets:
                    heapq.heappush(buckets[new], left)
                else:
                    buckets[new] = [left]
                    hi = new >> 8
                    words[hi] = words.get(hi, 0) | bit_of[new & 255]
                    summary |= bit_of[hi] if hi < 256 else 1 << hi
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


def _ranges(found: list[str], top: int) -> str:
    """A character class of runs of consecutive code points up to ``top``."""
    esc = lambda c: f"\\U{min(ord(c), top):08x}"
    return "".join(f"{esc(x[0])}-{esc(x[-1])}" for x in found if ord(x[0]) <= top)


def compile_patterns() -> tuple[re.Pattern, re.Pattern]:
    """The public pre-token pattern for the standard library's engine, which is faster; the first form is for
    texts without code points over U+FFFF, for which that engine uses one bitmap a class.

    The classes of letters, numbers and spaces are read from ``regex``, so both engines match alike; the
    alternatives that cannot start with the same character are reordered, most frequent first.
    """
    import regex

    # the code points in order, so that a run of matches is a range
    newer = {i for a, _, b in (x.partition("-") for x in NEWER.split()) for i in range(int(a, 16), int(b or a, 16) + 1)}
    known = (chr(i) if i not in newer else "\0" for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    points = "".join(known)
    runs = {k: regex.findall(rf"{p}+", points) for k, p in (("letter", r"\p{L}"), ("number", r"\p{N}"), ("space", r"\s"))}
    out = []
    for top in (0xFFFF, 0x10FFFF):
        letter, number, space = (_ranges(runs[k], top) for k in ("letter", "number", "space"))
        out.append(
            re.compile(
                rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+"
                rf"|[{space}]+(?![^{space}])|[{space}]+"
            )
        )
    return tuple(out)


class Codec:
    """Encoder and decoder of one vocabulary; one per Python worker."""

    def __init__(self, path: str, remembered: int = CACHE_SIZE):
        self.ranks = read_ranks(path)
        common, full = compile_patterns()
        beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.find = lambda text: (full if beyond(text) else common).findall(text)
        self.bytes_of = {str(i): b for b, i in self.ranks.items()}
        self.by_id = {i: b for b, i in self.ranks.items()}

        ranks, decimal = self.ranks, {i: str(i) for i in self.ranks.values()}

        class Known(dict):
            older: dict[str, str] = {}

            def __missing__(known, token: str) -> str:
                out = known.older.get(token)
                if out is None:
                    out = " ".join([decimal[i] for i in merge(token.encode(), ranks)])
                    if len(token) > CACHE_LENGTH:
                        return out
                if len(known) >= remembered:
                    known.older = dict(known)
                    known.clear()
                known[token] = out
                return out

        self.known = Known()

    def encode_decimal(self, text: str) -> str:
        """Decimal ids, one space between them."""
        return " ".join(map(self.known.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_decimal(text).split()))

    def decode_decimal(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, remembered: int = CACHE_SIZE) -> Codec:
    if (path, remembered) not in _CODECS:
        _CODECS[path, remembered] = Codec(path, remembered)
    return _CODECS[path, remembered]


def encode(df: DataFrame, text: str = "text", out: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """Add ``out``: array<int>, the ids of the whole text."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        parts = [np.array(codec(path).encode(t.as_py() or ""), np.int32) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(starts, np.concatenate([np.zeros(0, np.int32), *parts]))

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add ``out``: binary, the bytes that the ids stand for (null ids: empty)."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("binary")
    def data(arrays: pa.Array) -> pa.Array:
        return pa.array([codec(path).decode(a.as_py() or []) for a in arrays], pa.binary())

    return df.withColumn(out, data(F.col(ids)))


def tokens(df: DataFrame, keep: tuple[str, ...] = (), vocabulary: str | None = None) -> DataFrame:
    """doc_id, the columns named in ``keep``, n_tokens, token_ids and whether the ids decode to the text, in one pass."""
    path = vocabulary or default_vocabulary()
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for whole in batches:
            for i in range(0, len(whole), 64):
                batch, parts, same = whole.slice(i, 64), [np.zeros(0, np.int32)], []
                for value in batch.column(1):
                    text = value.as_py() or ""
                    ids = use.encode_decimal(text)
                    parts.append(np.fromstring(ids, np.int32, sep=" ") if ids else parts[0])
                    same.append(use.decode_decimal(ids) == text.encode())
                n = [len(x) for x in parts]
                lists = pa.ListArray.from_arrays(np.cumsum(n).astype(np.int32), np.concatenate(parts))
                columns = [batch.column(0), *batch.columns[2:], pa.array(n[1:], pa.int64()), lists, pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "n_tokens", "token_ids", "round_trip"])

    schema = ", ".join(filter(None, ["doc_id long", types, "n_tokens long, token_ids array<int>, round_trip boolean"]))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, schema)


def digests(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them, in one pass."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, CACHE_SIZE_ALONE)
        for batch in batches:
            n, ids_sha, out_sha = [], [], []
            for value in batch.column(1):
                ids = use.encode_decimal(value.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                out_sha.append(hashlib.sha256(use.decode_decimal(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(texts(spark, sf_dir))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLES: dict[str, str] = {}
