"""Repeated-substring dedup: a sparse suffix array whose buckets are refined by bucket pointers.

A bucket pointer is the name of the string of some length that begins at a byte.  Pointers of q-grams (q = length / 8) come
first; those of 2q, 4q and 8q bytes are made of the pointers at this and at a later offset, each level out of the one before.
Names are 64-bit mixes of content, so equal strings have equal names in all tasks, and buckets are always compared by two
independent names.

Suffixes (places where a string of ``length`` bytes starts) are sorted in runs, not one by one: all starts whose first q-gram
of least pointer is the same one form a run, cut by content alone, of about 0.44 x length starts.  The q-gram is the run's
first bucket.  A bucket is refined by grouping (the sort's only use here) its runs on the pointers at the run's first and
last start:

* a bucket of one run holds no repeat;
* runs of equal pointers are equal strings, so each of their starts is repeated;
* what is left is cut into shorter runs at places fixed by the q-gram, whose buckets are the strings that all their starts
  share, and refined again, down to single starts.  Of runs already known as repeated one stays as a witness for others.

Every step is an aggregate with partial sums and a join that AQE can split, so a passage that a third of all rows hold is no
hot task; no bucket is ever held by one task.  Strings never cross documents: a start is one only if ``length`` bytes follow in
its own text.  Long texts are worked on in pieces of PIECE starts.

Results for odd input: a null text is an empty one; texts shorter than ``length`` lose nothing; repeated rows and copies lose
all that ``length`` bytes cover; ids play no part, so null or repeated ids are kept as they are; an empty table gives no rows;
names of the caller's columns can be any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import discard, materialise, texts

LENGTH = 200
#: Starts that are worked on at once; less than 2**PLACE_BITS.
PIECE, PLACE_BITS = 1 << 19, 20
#: Of the shorter runs: a part of all starts of a run, then these.
FIRST_PARTS, SIZES = 7, (5, 1)
OPEN, WITNESS, REPEATED = 1, 0, 2

_ODD, _MIX, _STEP = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

RUN_SCHEMA = "bucket long, name long, d1 long, d2 long, at long, kind int"
ITEM_SCHEMA = f"{RUN_SCHEMA}, run long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _pair(a: np.ndarray, b: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    """Name of a pair of pointers, in this order."""
    return _mix(a * _STEP + b + np.asarray(more).astype(np.uint64) * _ODD)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(PLACE_BITS, int(n).bit_length())
    if size not in _powers:
        one = np.ones(1, np.uint64)
        back = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers[size] = tuple(np.cumprod(np.concatenate([one, np.full(size, x)])) for x in (_ODD, back))
    return _powers[size]


def pointers(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket pointers of length / 8, length / 2 and length bytes at every byte where so many follow."""
    q = length // 8
    grams = _mix(np.ndarray((len(data) - 7,), np.uint64, buffer=np.ascontiguousarray(data), strides=(1,)).copy())
    power, back = _power(len(grams) + 1)
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams * power[: len(grams)], out=sums[1:])
    of_q = _mix((sums[q - 7 :] - sums[: len(sums) - (q - 7)]) * back[: len(sums) - (q - 7)])
    made, size, half = of_q, q, of_q
    while size < length:
        half, made = made, _pair(made[:-size], made[size:])
        size *= 2
    return of_q, half, made


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every window of ``width`` keys."""
    rows = -(-len(keys) // width)
    whole = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(keys)] = keys
    whole = whole.reshape(rows, width)
    ahead = np.minimum.accumulate(whole, axis=1).ravel()
    behind = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(keys) - width + 1], ahead[width - 1 : len(keys)])


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last) of pieces of whole texts, or of a part of a long one."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        if offsets[last] - offsets[row] <= PIECE:
            yield row, last, int(offsets[row]), int(offsets[last])
        else:
            for begin in range(int(offsets[row]), int(offsets[last]), PIECE):
                yield row, last, begin, min(int(offsets[last]), begin + PIECE + length - 1)
        row = last


def find_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """bucket, name, row, first start, last start less the first, q-gram's place less the first start, of each piece's runs."""
    q = length // 8
    window, low = length - q + 1, np.uint64((1 << PLACE_BITS) - 1)
    for first, last, begin, end in _pieces(offsets, length):
        if end - begin < length:
            continue
        of_q, _, whole = pointers(data[begin:end], length)
        keys = (of_q & ~low) | np.arange(len(of_q), dtype=np.uint64)
        least = _least(keys, window)
        own = offsets[first : last + 1] - begin
        real = np.ones(len(least), bool)
        for cut in own[1:-1]:  # strings that reach into the next text
            real[max(0, cut - length + 1) : cut] = False
        new = np.ones(len(least) + 1, bool)
        new[1:-1] = (least[1:] != least[:-1]) | (real[1:] != real[:-1])
        cuts = np.flatnonzero(new)
        start, stop = cuts[:-1], cuts[1:] - 1
        start, stop = start[real[start]], stop[real[start]]
        place = (least[start] & low).astype(np.int64)
        row = np.searchsorted(own, start, side="right") - 1
        name = _pair(whole[start], whole[stop], stop - start)
        yield of_q[place], name, first + row, start - own[row], stop - start, place - start


def _packed(start: np.ndarray, width: np.ndarray, back: np.ndarray) -> np.ndarray:
    return (start << 32) | (width << 16) | back


def _once(bucket: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have an equal one in the piece, and which is the first of such."""
    order = np.lexsort((name, bucket))
    same = (bucket[order][1:] == bucket[order][:-1]) & (name[order][1:] == name[order][:-1])
    more, head = np.zeros(len(order), bool), np.zeros(len(order), bool)
    more[order[1:]], more[order[:-1]] = same, more[order[:-1]] | same
    first = np.ones(len(order), bool)
    first[1:] = ~same
    head[order] = first
    return more, head & more


def _joined(row: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of bytes that touch, of sorted ones, as one each."""
    stop = start + size
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > np.maximum.accumulate(row * (1 << 40) + stop)[:-1] - row[1:] * (1 << 40))
    heads = np.flatnonzero(new)
    stops = np.maximum.reduceat(stop, heads) if len(heads) else stop
    return row[heads], start[heads], stops - start[heads]


def _runs(length: int):
    """Map (d1, d2, data) to RUN_SCHEMA.  Runs that are equal within a piece are told apart at once: one witness is left of them,
    and their bytes are given as REPEATED stretches, so texts of a short period give few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = _bytes(batch.column(2))
            for bucket, name, row, start, width, back in find_runs(data, offsets, length):
                more, head = _once(bucket, name)
                at, kind = _packed(start, width, back), np.where(more, WITNESS, OPEN)
                use = ~more | head
                mine, begin, size = _joined(row[more], start[more], width[more] + length)
                stretch = (begin << 32) | size
                spread = _mix(d1[mine].view(np.uint64) + begin.astype(np.uint64))
                columns = (
                    np.concatenate([bucket[use], spread]).view(np.int64),
                    np.concatenate([name[use], spread]).view(np.int64),
                    np.concatenate([d1[row[use]], d1[mine]]),
                    np.concatenate([d2[row[use]], d2[mine]]),
                    np.concatenate([at[use], stretch]),
                    np.concatenate([kind[use], np.full(len(mine), REPEATED)]).astype(np.int32),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "name", "d1", "d2", "at", "kind"])

    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and where each value begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _stretch(length: int) -> Column:
    """Bytes that the starts of a run cover, as first byte and number."""
    return F.expr(f"shiftleft(shiftright(at, 32), 32) | ((shiftright(at, 16) & 65535) + {length})")


def refine(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """One refinement of all buckets: the repeated stretches (d1, d2, at), and the rows that need another one, witnesses included."""
    rest = [c for c in rows.columns if c not in ("bucket", "name", "kind")]
    sizes = rows.where(f"kind < {REPEATED}").groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("kind").alias("open"), F.min("name").alias("least"), F.max("name").alias("most")
    )
    # written first, as is every right side below, so that both sides of the join are exchanges and AQE can split a hot bucket
    sizes = materialise(sizes.where("n > 1 AND open > 0").select("bucket", (F.col("least") != F.col("most")).alias("mixed")), "buckets")
    live = rows.join(sizes, "bucket", "left").where(f"mixed IS NOT NULL OR kind = {REPEATED}")
    live = materialise(live, "bucket-runs")
    discard(sizes)
    mixed = live.where(f"mixed AND kind < {REPEATED}")
    first = F.min(F.struct(*rest)).alias("first")
    kinds = materialise(mixed.groupBy("bucket", "name").agg(F.count("*").alias("n"), first), "bucket-names")
    told = materialise(mixed.join(kinds, ["bucket", "name"]).drop("bucket", "mixed"), "told-runs")
    found = live.where(f"kind = {OPEN} AND NOT mixed").select("d1", "d2", _stretch(length).alias("at"))
    found = found.unionByName(live.where(f"kind = {REPEATED}").select("d1", "d2", "at"))
    found = found.unionByName(told.where(f"kind = {OPEN} AND n > 1").select("d1", "d2", _stretch(length).alias("at")))
    alone = F.col("n") == 1
    left = told.where(alone | (F.struct(*rest) == F.col("first")))
    return found, left.select(*rest, F.when(alone & (F.col("kind") == OPEN), OPEN).otherwise(WITNESS).cast("int").alias("kind"))


def _cut(batch_rows: tuple[np.ndarray, ...], data: np.ndarray, offsets: np.ndarray, size: int, length: int) -> tuple[np.ndarray, ...]:
    """Runs (value's number, its first start, first start, width, back) cut into shorter ones of at most ``size`` starts, with
    bucket and name; a value's bytes begin at its first start."""
    of, base, start, width, back = batch_rows
    _, half, whole = pointers(data, length)
    place = start + back
    low, high = (back - width) // size, back // size  # parts, counted from the q-gram backwards
    n = high - low + 1
    which = np.repeat(np.arange(len(of)), n)
    part = np.repeat(high, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    p, shift = place[which], (offsets[of] - base)[which]
    begin = np.maximum(start[which], p - part * size - size + 1)
    stop = np.minimum((start + width)[which], p - part * size)
    shared = p - part * size + shift  # the string that all starts of the part share, whether they are in the run or not
    bucket = _pair(half[shared], half[shared + length // 2 + 1 - size], size)
    name = _pair(whole[begin + shift], whole[stop + shift], stop - begin)
    return which, bucket, name, begin, stop - begin, p - begin


def _items(size: int, length: int):
    """Map (d1, d2, run, bytes of the run's starts, runs in it as [at, kind]) to ITEM_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2_000):
                batch = whole.slice(i, 2_000)
                d1, d2, runs = (batch.column(j).to_numpy() for j in (0, 1, 2))
                data, offsets = _bytes(batch.column(3))
                lists = batch.column(4)
                n = np.asarray(lists.value_lengths())
                parts = lists.flatten()
                at, kind = (parts.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                of = np.repeat(np.arange(len(batch)), n)
                rows = (of, (runs >> 32)[of], at >> 32, (at >> 16) & 65535, at & 65535)
                which, bucket, name, start, width, back = _cut(rows, data, offsets, size, length)
                mine = of[which]
                columns = (bucket.view(np.int64), name.view(np.int64), d1[mine], d2[mine], _packed(start, width, back), kind[which], runs[mine])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "name", "d1", "d2", "at", "kind", "run"])

    return run


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, data) with the data compressed, for the shuffle."""
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=1).compress
        data = pa.array([pack(memoryview(x.as_buffer())) for x in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], ["d1", "d2", "packet"])


def _contexts(length: int):
    """Map (d1, d2, packet, runs as [at, kind]) to a row for each run with the bytes of its starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                unpack = zstandard.ZstdDecompressor().decompress
                n = np.asarray(batch.column(3).value_lengths())
                parts = batch.column(3).flatten()
                at, data, j = parts.field(0).to_numpy(), [], 0
                for packet, k in zip(batch.column(2), n.tolist(), strict=True):
                    text = unpack(packet.as_py())
                    for a in at[j : j + k].tolist():
                        data.append(text[a >> 32 : (a >> 32) + ((a >> 16) & 65535) + length])
                    j += k
                of = np.repeat(np.arange(len(batch)), n)
                columns = [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), parts.field(0), parts.field(1), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "run", "kind", "data"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map (d1, d2, packet, stretches) to the removed spans, joined, and the bytes outside them."""
    for whole in batches:
        for i in range(0, len(whole), 256):
            batch = whole.slice(i, 256)
            unpack = zstandard.ZstdDecompressor().decompress
            sizes, spans, kept = [], [], []
            for packet, found in zip(batch.column(2), batch.column(3), strict=True):
                text, out, end = unpack(packet.as_py()), [], 0
                pairs: list[dict] = []
                at = np.sort(found.values.to_numpy()) if found.is_valid else np.zeros(0, np.int64)
                _, begin, size = _joined(np.zeros(len(at), np.int64), at >> 32, at & 0xFFFFFFFF)
                for b, n in zip(begin.tolist(), size.tolist(), strict=True):
                    out.append(text[end:b])
                    end = b + n
                    pairs.append({"start": b, "end": end})
                out.append(text[end:])
                sizes.append(len(text))
                spans.append(pairs)
                kept.append(b"".join(out))
            pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "n_bytes", "spans", "kept"])


def keyed(data: Column) -> tuple[Column, Column]:
    """The 128 bits that stand for a text."""
    return F.xxhash64(data).alias("d1"), F.xxhash64(F.lit("second"), data).alias("d2")


def _grouped(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.collect_set(F.struct("at", "kind")).alias("runs"))


def strip_texts(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """d1, d2 (see ``keyed``), n_bytes, spans (start, end: the maximal stretches of bytes that a repeated string of ``length``
    bytes covers) and kept (binary, the other bytes), one row for each distinct text of ``df``."""
    if length % 8 or not 64 <= length <= 32_768:
        raise ValueError("the length must be a multiple of 8 from 64 to 32,768")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    source = df.select(*keyed(data), data.alias("data"))
    packets = source.mapInArrow(_packets, "d1 long, d2 long, packet binary").groupBy("d1", "d2").agg(F.first("packet").alias("packet"))
    found, left = refine(source.mapInArrow(_runs(length), RUN_SCHEMA), length)
    stretches = [found]
    opened = _grouped(left, "d1", "d2")
    context_schema = "d1 long, d2 long, run long, kind int, data binary"
    contexts = materialise(packets.join(opened, ["d1", "d2"]).mapInArrow(_contexts(length), context_schema), "run-bytes")
    parts = contexts.select("d1", "d2", "run", "data", F.array(F.struct(F.col("run").alias("at"), "kind")).alias("runs"))
    for size in (-(-(length - length // 8 + 1) // FIRST_PARTS), *SIZES):
        found, left = refine(parts.mapInArrow(_items(size, length), ITEM_SCHEMA), length)
        stretches.append(found)
        parts = contexts.drop("kind").join(_grouped(left, "d1", "d2", "run"), ["d1", "d2", "run"]).select("d1", "d2", "run", "data", "runs")
    every = stretches[0]
    for found in stretches[1:]:
        every = every.unionByName(found)
    marks = every.groupBy("d1", "d2").agg(F.collect_set("at").alias("found"))
    schema = "d1 long, d2 long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return packets.join(marks, ["d1", "d2"], "left").mapInArrow(_kept, schema)


def strip(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with n_bytes, spans and kept_text (what is left, broken characters replaced) for each row; columns of these names are
    replaced."""
    result = materialise(strip_texts(df, text, length), "stripped-texts")
    made = F.struct("n_bytes", "spans", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
    own = [c for c in df.columns if c not in ("n_bytes", "spans", "kept_text")]
    d1, d2 = keyed(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), d1, d2)
    return rows.join(result.select("d1", "d2", made.alias("made")), ["d1", "d2"]).select("row.*", "made.*")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    spans = "aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"
    made = strip_texts(docs).select(
        "d1", "d2", "n_bytes", F.expr(spans).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
    # one small row for each distinct text is joined to all documents that have it
    made = materialise(made, "stripped-digests")
    return docs.select("doc_id", *keyed(F.coalesce("text", F.lit("")).cast("binary"))).join(made, ["d1", "d2"]).drop("d1", "d2")


QUERIES = {"op11_suffix_dedup": op11_suffix_dedup}
#: In SQL a row for each byte would be needed; tests hold the query against brute force.
ORACLES: dict[str, str] = {}
