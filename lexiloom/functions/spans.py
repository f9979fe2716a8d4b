"""Offsets in code points, ends exclusive from the moment of creation."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

ABSENT = "mention not in text"


def occurrences(content: str, mentions: list[str]) -> list[int | None]:
    """For each mention, the start of its k-th occurrence, k counting equal mentions in the list so far; None if there are fewer.

    Occurrences can overlap.  One Aho-Corasick pass finds those of all mentions; it ends when each has as many as are asked for.
    """
    import ahocorasick

    asked = Counter(mentions)
    found: dict[str, list[int]] = {m: [] for m in asked}
    if "" in asked:  # stands before every character and at the end
        found[""] = list(range(min(asked[""], len(content) + 1)))
    machine = ahocorasick.Automaton()
    for m in asked:
        if m:
            machine.add_word(m, m)
    left = len(machine)
    if left:
        machine.make_automaton()
        for end, m in machine.iter(content):
            places = found[m]
            if len(places) < asked[m]:
                places.append(end + 1 - len(m))
                if len(places) == asked[m]:
                    left -= 1
                    if not left:
                        break
    seen: Counter = Counter()
    out: list[int | None] = []
    for m in mentions:
        out.append(found[m][seen[m]] if seen[m] < len(found[m]) else None)
        seen[m] += 1
    return out


@F.arrow_udf(ArrayType(IntegerType()))
def _places(contents: pa.Array, lists: pa.Array) -> pa.Array:
    made = [occurrences(c.as_py() or "", m.as_py()) for c, m in zip(contents, lists, strict=True)]
    return pa.array(made, pa.list_(pa.int32()))


def reanchor(mentions: DataFrame, contents: DataFrame) -> DataFrame:
    """Move the k-th annotation of a mention, by its reported start, to the mention's k-th occurrence in the document.

    mentions: doc_id, mention, start, ordinal, ...; contents: doc_id, content, one row a document.  A mention that is absent keeps
    null offsets and gets an ``error``; null mentions and those with "No text" are dropped first, as are those of unknown documents.
    A null content is an empty one.  A text meets the list of its mentions, once, and is read once.
    """
    rest = [c for c in mentions.columns if c not in ("doc_id", "start", "end")]
    # the order within a document is that of the first two fields; equal ones may stand in any order
    one = F.struct(F.col("start").alias("__by"), "ordinal", *[c for c in rest if c != "ordinal"])
    kept = mentions.where(~F.col("mention").contains("No text"))
    lists = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    placed = lists.join(contents.select("doc_id", "content"), "doc_id").withColumn("at", _places("content", F.col("m.mention")))
    rows = placed.select("doc_id", F.explode(F.arrays_zip("m", "at")).alias("x"))
    at = F.col("x.at")
    return rows.select(
        "doc_id", *[F.col("x.m")[c].alias(c) for c in rest], at.alias("start"), (at + F.length(F.col("x.m.mention"))).alias("end"),
        F.when(at.isNull(), F.lit(ABSENT)).alias("error"),
    ).select(*[c for c in mentions.columns if c not in ("start", "end")], "start", "end", "error")
