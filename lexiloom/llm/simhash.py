"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each a word of the Golay code [23, 12, 7] (shortened by leading
zeros).  ``link`` joins fingerprints at RADIUS = 2 or fewer differing bits, exactly: of three segments one has no
error (pigeonhole), and the next one has at most two, so the pair shares a key made of the first segment and one
of the few codeword indices near the second; candidates are verified by their true distance.  Equal fingerprints are
combined first.  Buckets of more than COLD fingerprints are not paired: their fingerprints are looked up by all
words within one bit, of which two linked fingerprints always share one and which at most 65 fingerprints share.

``near_duplicates`` is for similarity: shingle sets at a Jaccard similarity of 0.8 or more, where a tenth to a sixth of
the bits differ.  Its fingerprints have 256 bits, of which TABLES segments of 23 give codeword indices; a key is one of
these with an anchor, the least shingle hash under the segment's own mix.  A similar pair has one anchor in common with
a probability of its similarity and a key of one table in half of all cases, so that of eight tables one finds it
(0.995 at 0.8), while unlike texts seldom meet, however many there are.  Pairs are verified on the shingles themselves.
The bits of short texts differ more, so sets of at most SHORT shingles are compared exactly, by their rarest shingles.

Results for odd input: null and empty texts have no words and fingerprint zero, and are linked like any other;
texts are hashed whole; repeated rows are rows of their own with the same result; a null doc_id is never a
component's smallest id unless it has no other; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import golay
from lexiloom.llm.common import materialise, texts
from lexiloom.llm.components import components

SEED, RADIUS = 42, 2
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of a bucket that are compared pair by pair; larger buckets take the other way.
COLD = 32
#: For near_duplicates: words of a shingle and the least similarity; segments and anchors; longs of a fingerprint; bits that
#: candidates may differ in (at a similarity of 0.8 a pair differs in 39 on average, with a deviation of 6); anchors that a row
#: with a link must have in common with others.
WORDS, SIMILARITY, TABLES, LONGS, BITS, ANCHORS = 5, 0.8, 8, 4, 60, 3
#: Shingles of a set up to which near_duplicates links sets of the similarity exactly, whatever their bits are.
SHORT = 64
PARTS = [f"p{i}" for i in range(LONGS)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; shorter texts have one run, empty ones none."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    data = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxh64_intdigest(data, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate([[0], gaps[: len(tokens) - words] + 1]).tolist()
    ends = np.concatenate([gaps[words - 1 :], [len(data)]]).tolist()
    return np.array([xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a map over rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(x.as_py(), words)) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp.view(np.uint64) >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]


def exact_fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: each segment as it is with a codeword index of the next one."""
    cut = segments(fp)
    rows, out = [], []
    for i in range(3):
        near = golay.keys(cut[(i + 1) % 3])
        at, k = np.nonzero(near >= 0)
        rows.append(at)
        out.append(i << 60 | cut[i][at] << 12 | near[at, k])
    return np.concatenate(rows), np.concatenate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on each other (SplitMix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint (LONGS words) and anchors (TABLES least mixed hashes; all ones if there are no shingles)."""
    offsets = np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts, least = np.zeros(64 * LONGS, np.int64), np.full(TABLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 14):
        mixed = mix(hashes[i : i + (1 << 14), None] + offsets)
        least = np.minimum(least, mixed.min(axis=0))
        bits = np.unpackbits(np.ascontiguousarray(mixed[:, :LONGS]).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64), least


def anchored_keys(parts: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints (n x LONGS) and anchors (n x TABLES); a key ends in its table's number."""
    bits = np.unpackbits(np.ascontiguousarray(parts).view(np.uint8), axis=1, bitorder="little")
    rows, out = [], []
    for i in range(TABLES):
        near = golay.keys(bits[:, i * golay.LENGTH : (i + 1) * golay.LENGTH] @ (1 << np.arange(golay.LENGTH)))
        at, k = np.nonzero(near >= 0)
        mixed = mix(anchors[at, i] + mix(near[at, k].astype(np.uint64)))
        rows.append(at)
        out.append(((mixed & ~np.uint64(TABLES - 1)) | np.uint64(i)).view(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def keyed(distinct: DataFrame) -> DataFrame:
    """One row (key, fp) for each exact fuzzy key of each ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1024):
                fp = whole.column(0).slice(i, 1024)
                at, key = exact_fuzzy_keys(fp.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(key), fp.take(pa.array(at))], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def anchored(sets: DataFrame) -> DataFrame:
    """One row (key, doc_id) for each anchored fuzzy key of each row of ``sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 1024):
                batch = whole.slice(i, 1024)
                parts = np.stack([c.to_numpy() for c in batch.columns[1 : 1 + LONGS]], axis=1)
                anchors = batch.column(1 + LONGS).flatten().to_numpy().view(np.uint64).reshape(-1, TABLES)
                at, key = anchored_keys(parts, anchors)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(at))], ["key", "doc_id"])

    return sets.select("doc_id", *PARTS, "anchors").mapInArrow(run, "key long, doc_id long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows whose key others have too, with their number ``n_key``; counts are combined per task first."""
    counts = materialise(rows.groupBy("key").agg(F.count("*").alias("n_key")).where("n_key > 1"), "buckets")
    return materialise(rows.join(counts, "key"), "bucket-rows")


def midpoint_edges(fps: DataFrame) -> DataFrame:
    """Links of a set of distinct fingerprints without any pairs: 65 rows each, stars of at most 65."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = fps.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("mid"))
    stars = near.groupBy("mid").agg(F.sort_array(F.collect_set("fp")).alias("s")).where("size(s) > 1")
    return stars.select(F.explode(F.slice("s", 2, 65)).alias("a"), F.element_at("s", 1).alias("b"))


def link(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp) at RADIUS or fewer differing bits."""
    rows = shared_buckets(keyed(distinct))
    cold = rows.where(f"n_key <= {COLD}").select("key", "fp")
    a, b = cold.alias("a"), cold.alias("b")
    close = F.expr(f"a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= {RADIUS}")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & close).select(F.col("b.fp").alias("a"), F.col("a.fp").alias("b"))
    hot = rows.where(f"n_key > {COLD}").select("fp").distinct()
    return pairs.unionByName(midpoint_edges(hot))


def classes(rows: DataFrame) -> DataFrame:
    """component_id of every row (doc_id, fp)."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("own")), "fingerprints-distinct")
    found = components(link(distinct))
    linked = distinct.join(found, distinct["fp"] == found["node"])
    least = materialise(linked.groupBy("root").agg(F.min("own").alias("least")), "components-least")
    labels = materialise(found.join(least, "root").select(F.col("node").alias("fp"), "least"), "components-labels")
    named = distinct.join(labels, "fp", "left").select("fp", F.coalesce("least", "own").alias("component_id"))
    return rows.join(materialise(named, "fingerprints-named"), "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(fingerprints(texts(spark, sf_dir), 3), "fingerprints")
    return classes(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketches(df: DataFrame, words: int) -> DataFrame:
    """doc_id, fingerprint (PARTS), anchors, size and digest of every row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            n = len(batch)
            parts, anchors = np.zeros((n, LONGS), np.uint64), np.zeros((n, TABLES), np.uint64)
            size, digest = np.zeros(n, np.int32), np.zeros(n, np.uint64)
            for i, text in enumerate(batch.column(1)):
                shingles = np.unique(shingle_hashes(text.as_py(), words))
                parts[i], anchors[i] = sketch(shingles)
                size[i], digest[i] = len(shingles), xxh64_intdigest(shingles.tobytes())
            starts = pa.array(np.arange(n + 1, dtype=np.int32) * TABLES)
            columns = [batch.column(0), *(pa.array(parts[:, i].view(np.int64)) for i in range(LONGS))]
            columns += [pa.ListArray.from_arrays(starts, pa.array(anchors.reshape(-1).view(np.int64)))]
            columns += [pa.array(size), pa.array(digest.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *PARTS, "anchors", "size", "digest"])

    schema = f"doc_id long, {', '.join(f'{p} long' for p in PARTS)}, anchors array<long>, size int, digest long"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _sets(df: DataFrame, words: int) -> DataFrame:
    """doc_id and the shingle set (32 bits of each hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                batch = whole.slice(i, 256)
                short = [np.unique(shingle_hashes(x.as_py(), words).astype(np.uint32)).view(np.int32) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.list_(pa.int32()))], ["doc_id", "shingles"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, shingles array<int>")


def _pairs(rows: DataFrame, other: DataFrame, also: str) -> DataFrame:
    """Pairs (a < b) of rows and others of one key whose sizes and fingerprints allow the similarity."""
    differ = " + ".join(f"bit_count(a.{p} ^ b.{p})" for p in PARTS)
    near = f"(greatest(a.size, b.size) <= {SHORT} OR {differ} <= {BITS})"
    fits = f"a.key = b.key AND {also} AND least(a.size, b.size) >= {SIMILARITY} * greatest(a.size, b.size) AND {near}"
    both = rows.alias("a").join(other.alias("b"), F.expr(fits))
    return both.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"))


def stars(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b: doc_id) of every row with the leader of each of its buckets, if sizes and fingerprints allow the similarity;
    and the rows (key, doc_id) of all buckets of two rows or more.

    The leader is the row with the most neighbours over all its buckets, so that in a group of like texts the row nearest to
    most others leads most buckets: a group gives pairs in proportion to its rows, however large it is.
    """
    buckets = shared_buckets(anchored(sets))
    busy = materialise(buckets.groupBy("doc_id").agg(F.sum("n_key").alias("mates")), "bucket-mates")
    leaders = buckets.join(busy, "doc_id").groupBy("key").agg(F.min_by("doc_id", F.struct(-F.col("mates"), "doc_id")).alias("leader"))
    led = buckets.join(materialise(leaders, "leaders"), "key").where("doc_id <> leader").select(F.col("leader").alias("key"), "doc_id").distinct()
    fields = sets.select("doc_id", "size", *PARTS)
    led = materialise(led, "led-rows").join(fields, "doc_id").select("key", "doc_id", "size", *PARTS)
    return _pairs(led, fields.select(F.col("doc_id").alias("key"), "*"), "a.doc_id <> b.doc_id").distinct(), buckets


def _mixed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those of the rows (keys, root) whose keys have rows of several roots."""
    several = rows.groupBy(*keys).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return rows.join(materialise(several.select(*keys), "mixed-keys"), keys)


def unsettled(buckets: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and root of the rows that can have a link to a row outside their component (``found``: node, root).

    Such a link joins rows that share a bucket, and at the similarity 6.4 of eight anchors on average, ANCHORS but for 0.0012 of
    all pairs.  So a row of a bucket of several components counts if ANCHORS of its anchors, whichever rows these are, stand in
    other components too: a passage in unlike texts seldom gives that many.  Short texts all count.
    """
    named = buckets.join(found, buckets["doc_id"] == found["node"], "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    near = materialise(_mixed(materialise(named, "bucket-roots"), ["key"]).select("doc_id", "root").distinct(), "mixed-rows")
    spread = near.join(sets.select("doc_id", "anchors"), "doc_id").select("doc_id", "root", F.posexplode("anchors").alias("pos", "anchor"))
    common = _mixed(materialise(spread, "mixed-anchors"), ["pos", "anchor"]).groupBy("doc_id", "root").agg(F.count("*").alias("n"))
    short = sets.where(f"size <= {SHORT}").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))
    return materialise(common.where(f"n >= {ANCHORS}").select("doc_id", "root").unionByName(short).distinct(), "unsettled")


def _rarest(rows: DataFrame, held: DataFrame) -> DataFrame:
    """key, doc_id and root of each row (doc_id, root) for its set's rarest shingles, those of one row left out; with the
    set's length and room, the number of shingles from this one on.

    The sets, ordered by rarity, are cut to so many that two sets of the similarity have one in common (prefix filtering).
    From the first one in common on, both have room for all that they need to share.
    """
    every = rows.join(held, "doc_id").select("doc_id", "root", F.size("shingles").alias("length"), F.explode("shingles").alias("key"))
    every = materialise(every, "shingle-rows")
    counts = materialise(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shingle-counts")
    shared = every.join(counts, "key").groupBy("doc_id", "root", "length").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("s"))
    first = F.expr(f"greatest(length - ceil({SIMILARITY}D * length - 1e-9D) + 1 - (length - size(s)), 0)").cast("int")
    cut = shared.select("doc_id", "root", "length", F.size("s").alias("rest"), F.posexplode(F.slice("s", F.lit(1), first)).alias("i", "x"))
    return cut.select(F.col("x.key").cast("long").alias("key"), "doc_id", "root", "length", (F.col("rest") - F.col("i")).alias("room"))


def across(rows: DataFrame, sets: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of rows (doc_id, root) of different components that share one of their rarest shingles and whose sizes and
    fingerprints allow the similarity.

    No similar pair of two of the rows that fits is lost; a large group of copies is not paired with itself; a passage in many
    unlike texts, being common, pairs none of them.  A row stays in a key's group only if its room suffices for the shortest set
    there, so rows that lie too far from a large group to link to any of it leave before they are paired.
    """
    need = lambda one, both: f"{one} * (1 + {SIMILARITY}D) + 1e-9D >= {SIMILARITY}D * ({both})"
    cut = materialise(_rarest(rows, held), "rarest")
    sizes = materialise(cut.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("length").alias("short")), "rarest-sizes")
    groups = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.min("short").alias("short"))
    groups = materialise(groups.where("roots > 1").drop("roots"), "rarest-keys")
    fit = cut.join(groups, "key").where(need("room", "length + short")).drop("short").join(sets.select("doc_id", "size", *PARTS), "doc_id")
    fit = materialise(fit, "rarest-mixed")
    apart = f"a.root <> b.root AND (b.root = b.main OR a.doc_id < b.doc_id) AND {need('least(a.room, b.room)', 'a.length + b.length')}"
    return _pairs(fit.where("root <> main"), fit, apart).distinct()


def _alike(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""
    left, right = (held.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    return both.where(f"n >= {SIMILARITY} * (size(sa) + size(sb) - n)").select("a", "b")


def near_duplicates(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and component_id of every row: near-duplicate groups by the similarity of shingle sets (SIMILARITY).

    Equal sets are one class from the start.  Classes that share an anchored fuzzy key are verified against their buckets'
    leaders; what that leaves in several components of one bucket, and all short classes, by their rarest shingles.
    """
    sets = materialise(_sketches(df, words), "shingle-sets")
    same = ["size", "digest"]
    fields = [F.min_by(c, "doc_id").alias(c) for c in (*PARTS, "anchors")]
    distinct = sets.where("doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("doc_id"), *fields)
    distinct = materialise(distinct, "shingle-classes")
    pairs, buckets = stars(distinct)
    asked = buckets.select("doc_id").unionByName(distinct.where(f"size <= {SHORT}").select("doc_id"))
    held = _sets(df, words).join(materialise(asked.distinct(), "candidate-ids"), "doc_id")
    held = materialise(held.dropDuplicates(["doc_id"]), "candidate-sets")
    links = materialise(_alike(materialise(pairs, "candidates"), held), "links")
    found = materialise(components(links), "near-components")
    more = materialise(across(unsettled(buckets, distinct, found), distinct, held), "candidates-across")
    more = materialise(_alike(more, held), "links-across")
    if not more.isEmpty():
        joined = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = materialise(components(joined.unionByName(more)), "near-components-all")
    named = distinct.join(found, distinct["doc_id"] == found["node"], "left").select(*same, F.coalesce("root", "doc_id").alias("component_id"))
    return sets.select("doc_id", *same).join(materialise(named, "near-named"), same, "left").select("doc_id", "component_id")


def keep_one(df: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``df`` (unique doc_id) that stay: of each near-duplicate group the smallest doc_id; null ids stay."""
    gone = near_duplicates(df, words).where("doc_id <> component_id").select("doc_id").distinct()
    return df.join(materialise(gone, "near-duplicates"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
