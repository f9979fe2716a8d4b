"""Pattern taggers: miRNA names by a regex behind a gate, gazetteer names by one automaton.  Arrow maps over whole texts.

Results for odd input: null and empty texts have no mentions; texts are searched whole, in time linear in their length; repeated
rows give repeated mentions (``tag_names`` with a dictionary of several blocks asks for unique doc_id); empty dictionaries find
nothing; empty names are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a miRNA name begins with, and what must follow its number.
PREFIXES = (
    "bta-mir-", "rno-mir-", "gga-mir-", "cel-mir-", "ssc-mir-", "ebv-mir-", "mdv1-mir-", "hcmv-mir-",
    "mir", "mir-", "mirna", "mirna-", "microrna", "microrna-", "micro rna", "micro-rna-", "let-", "mirna-let-", "mir-let-",
    "hsa-mir-", "mmu-", "hsa-let-",
)
SUFFIXES = ("[-]?[a-c]-[12]-[35]p", "[-]?[a-c]-[35]p", "-[12]-[35]p", "[a-c]", "-[12]", "-[35]p", "[*]", "[0-9]+")


#: Characters of dictionary names that one automaton holds; a larger dictionary is searched in blocks.
BLOCK_CHARS = 8_000_000
MENTIONS = "ordinal int, start int, end int, mention string"


def mirna_pattern(prefixes: tuple[str, ...] = PREFIXES, suffixes: tuple[str, ...] = SUFFIXES) -> re.Pattern:
    """Prefix, one to three digits and a suffix, which is mandatory; the first alternative that fits wins."""
    ends = "|".join(rf"[0-9]{{1,3}}{s}\b" for s in suffixes)
    return re.compile(rf"\b(?:{'|'.join(prefixes)})(?:{ends})", re.IGNORECASE)


def mirna_spans(text: str, pattern: re.Pattern, last: re.Pattern, longest: int) -> Iterator[re.Match]:
    """The pattern's matches from left to right: it is tried only before digits that a prefix's last character precedes."""
    done = 0
    for digit in last.finditer(text):
        at = digit.end() - 1
        if at > done:
            found = next((m for i in range(max(done, at - longest), at) if (m := pattern.match(text, i))), None)
            if found:
                yield found
                done = found.end()


def tag_mirna(docs: DataFrame, prefixes: tuple[str, ...] = PREFIXES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """doc_id, ordinal, start, end, mention from doc_id, content.

    The gate, a prefix's last character before a digit, is sought in Python: as a filter it would repeat whatever expression made the
    content.  Prefixes hold no digit that another prefix's end precedes.
    """
    pattern, longest = mirna_pattern(prefixes, suffixes), max(map(len, prefixes))
    last = re.compile(f"[{re.escape(''.join(sorted({p[-1] for p in prefixes})))}][0-9]", re.IGNORECASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, spans = [], [], []
            for r, c in enumerate(batch.column(1)):
                found = list(mirna_spans(c.as_py() or "", pattern, last, longest))
                row += [r] * len(found)
                n += range(len(found))
                spans += found
            numbers = [pa.array(x, pa.int32()) for x in (n, [m.start() for m in spans], [m.end() for m in spans])]
            out = [batch.column(0).take(pa.array(row, pa.int64())), *numbers, pa.array([m[0] for m in spans], pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ordinal", "start", "end", "mention"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {key}, {MENTIONS}")


def mirna_code(mention: Column) -> Column:
    """The number and what follows it, without the arm."""
    return F.regexp_replace(F.regexp_extract(mention, "[0-9]+.*", 0), "-[35]p", "")


#: By the first letters of a mention, in lower case: what the name that is taken begins with, in order of preference.
SPECIES = {"let": ("hsa-let", "mmu-let"), "hsa": ("hsa-mir",), "mmu": ("mmu-mir",), "": ("hsa", "mmu")}


def normalize_mirna(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add oid (empty: unknown).  dictionary: name (as hsa-mir-21), code, oid, dict_order.

    Keys are tried in turn: the code, in lower case, its digits, those without leading zeros, then the first name of the
    dictionary that goes on with a letter; of several names the mention's beginning picks the species.  The dictionary is
    brought to one row a code first, so mentions are only looked up, never grouped.
    """
    code = mirna_code(F.col("mention"))
    digits = F.regexp_extract(code, "^[0-9]+", 0)
    keys = {"__k0": code, "__k1": F.lower(code), "__k2": digits, "__k3": F.ltrim(digits, F.lit("0"))}

    def best(wanted: tuple[str, ...]) -> Column:
        place = F.lit(len(wanted))
        for i, w in reversed(list(enumerate(wanted))):
            place = F.when(F.lower("name").startswith(w), i).otherwise(place)
        return F.min_by("oid", F.struct(place, "dict_order"))

    codes = dictionary.groupBy("code").agg(F.map_from_arrays(F.array(*map(F.lit, SPECIES)), F.array(*map(best, SPECIES.values()))).alias("by"))
    series = dictionary.withColumn("base", F.regexp_extract("code", "^([0-9]+)[a-z]", 1)).where("base <> ''")
    series = series.groupBy(F.col("base").alias("__k4")).agg(F.min_by("oid", "dict_order").alias("__o4"))
    kind = F.lower(F.substring("mention", 1, 3))
    out = mentions.withColumns(keys | {"__k4": digits, "__kind": F.when(kind.isin(*[k for k in SPECIES if k]), kind).otherwise("")})
    for i in range(4):
        out = out.join(codes.select(F.col("code").alias(f"__k{i}"), F.col("by").alias(f"__b{i}")), f"__k{i}", "left")
    out = out.join(series, "__k4", "left")
    oid = F.coalesce(*[F.try_element_at(f"__b{i}", F.col("__kind")) for i in range(4)], F.col("__o4"), F.lit(""))
    return out.withColumn("oid", oid).drop(*keys, "__k4", "__o4", "__kind", *[f"__b{i}" for i in range(4)])


def chosen(hits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Of hits (start, order, end) from left to right the first in order, and none that overlaps one already taken."""
    last = 0
    for start, order, end in sorted(hits):
        if start >= last:
            yield start, order, end
            last = end


def tag_names(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, ordinal, start, end, mention: names (name, dict_order) in texts (doc_id, content), literally and case-sensitively.

    From left to right the first name in dictionary order is taken, and what overlaps it is not.  An automaton of all names reads
    each text once.  A dictionary of over BLOCK_CHARS characters is dealt into blocks with an automaton each, whose hits, not the
    texts, are brought together by document.
    """
    import ahocorasick

    rows = names.where("name <> ''").groupBy("name").agg(F.min("dict_order").cast("int").alias("dict_order"))
    blocks = max(1, math.ceil((rows.agg(F.sum(F.length("name"))).first()[0] or 0) / BLOCK_CHARS))
    key = docs.schema["doc_id"].dataType.simpleString()

    def searched(block: int) -> DataFrame:
        """Hits of a block's names; the chosen ones if there is no other block."""
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast([(r["name"], r["dict_order"]) for r in mine.collect()])  # a block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for name, order in shared.value:
                automaton.add_word(name, (order, len(name)))
            automaton.make_automaton()
            for batch in batches:
                row, n, start, end, mention, orders = [], [], [], [], [], []
                for r, c in enumerate(batch.column(1)):
                    text = c.as_py()
                    hits = [(e + 1 - size, order, e + 1) for e, (order, size) in automaton.iter(text)] if text and len(automaton) else []
                    for i, (a, order, b) in enumerate(chosen(hits) if blocks == 1 else hits):
                        row.append(r)
                        n.append(i)
                        start.append(a)
                        end.append(b)
                        mention.append(text[a:b])
                        orders.append(order)
                numbers = [pa.array(x, pa.int32()) for x in (n, start, end)]
                out = [batch.column(0).take(pa.array(row, pa.int64())), *numbers, pa.array(mention, pa.string()), pa.array(orders, pa.int32())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ordinal", "start", "end", "mention", "dict_order"])

        return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {key}, {MENTIONS}, dict_order int")

    found = searched(0)
    for block in range(1, blocks):
        found = found.unionByName(searched(block))
    if blocks > 1:

        def of_document(pdf: pd.DataFrame) -> pd.DataFrame:
            taken = {(a, o) for a, o, _ in chosen(list(zip(pdf["start"], pdf["dict_order"], pdf["end"], strict=True)))}
            kept = pdf[[x in taken for x in zip(pdf["start"], pdf["dict_order"], strict=True)]].sort_values("start")
            return kept.assign(ordinal=range(len(kept)))

        found = found.groupBy("doc_id").applyInPandas(of_document, found.schema)
    return found.drop("dict_order")


def with_ids(mentions: DataFrame, external: DataFrame, prefix: str) -> DataFrame:
    """Column ids of mentions with an oid: the external accession first if there is one, then the prefixed own id.

    external: oid, ext_id (one row an oid).
    """
    own = F.concat(F.lit(prefix), F.coalesce("oid", F.lit("")))
    known = mentions.join(external.select("oid", "ext_id"), "oid", "left")
    return known.withColumn("ids", F.when(F.coalesce("ext_id", F.lit("")) != "", F.array("ext_id", own)).otherwise(F.array(own))).drop("ext_id")


def mirna_tagger(dictionary: DataFrame, prefix: str = "ID:"):
    """A pattern tagger of miRNA names; dictionary: name, code, oid, dict_order, ext_id."""
    external = dictionary.groupBy("oid").agg(F.min_by("ext_id", "dict_order").alias("ext_id"))
    return lambda docs: with_ids(normalize_mirna(tag_mirna(docs), dictionary), external, prefix).drop("oid")


def pathway_tagger(dictionary: DataFrame, prefix: str = "ID:"):
    """A pattern tagger of pathway names; dictionary: name, oid, kegg, dict_order (as ``dictionaries.parse_pathways`` gives)."""
    ids = dictionary.select(F.col("name").alias("mention"), "oid", F.col("kegg").alias("ext_id"))

    def tagger(docs: DataFrame) -> DataFrame:
        found = tag_names(docs, dictionary).join(ids, "mention")
        own = F.concat(F.lit(prefix), "oid")
        full = F.when(F.coalesce("ext_id", F.lit("")) != "", F.array("ext_id", own)).otherwise(F.array(own))
        return found.select("doc_id", "ordinal", "start", "end", "mention", full.alias("ids"))

    return tagger
