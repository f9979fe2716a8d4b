"""The whole plan: clean, segment, tag, decode, add mutations, resolve, filter, normalise by type, tag patterns, format.

Results for odd input: documents (unique doc_id) without entities keep an empty list; mutations whose mention is not in the text
are left out; types without a normalizer have unknown ids; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import spans
from lexiloom.functions import text as T
from lexiloom.operators import dictionaries as dic
from lexiloom.operators import segment, tagging
from lexiloom.operators.plugins import Registry, TokenTagger, sentence_tagger
from lexiloom.plans import formats
from lexiloom.tables import materialise, spread

COLUMNS = "doc_id etype ordinal start end score mention mutation_type normalized_name".split()


def by_length(etype: str, nth: np.ndarray, word: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of eight characters or more are mentions, their type follows from their length, longer ones are surer; words of six
    or seven go on with the mention before them.
    """
    n, at = pc.utf8_length(word).to_numpy(), np.arange(len(word))
    begins = n >= 8
    before = np.maximum.accumulate(np.where((n < 6) | begins, at, -1)) if len(n) else at  # the last word that does not go on
    of_type = begins & (np.array(tagging.RIVALS)[n % 4] == etype)
    kept = np.flatnonzero((n >= 6) & (before >= at - nth) & of_type[before])
    return kept, np.where(begins[kept], "B", "I"), n[kept] % 10 / 10.0


#: The default plug-in; it stands for a trained tagger, as ``plugins.model_tagger`` makes one.
gazetteer_tagger = sentence_tagger(by_length)


def documents(table: DataFrame, unicode: bool = False) -> DataFrame:
    """Documents of raw texts (doc_id, text): doc_id, title (null), abstract, with requests' cleaning; ``unicode`` also takes odd
    blanks and signs out, as for documents of files.
    """
    text = F.coalesce("text", F.lit(""))
    cleaned = table.select("doc_id", T.clean_request(T.clean_unicode(text) if unicode else text).alias("abstract"))
    return cleaned.select("doc_id", F.lit(None).cast("string").alias("title"), T.guard_letters(F.col("abstract")).alias("abstract"))  # cleaned once


def contents(docs: DataFrame) -> DataFrame:
    """doc_id and content, what offsets refer to."""
    return docs.select("doc_id", T.content(F.col("title"), F.col("abstract")).alias("content"))


def mutations(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Entities of a mutation tagger's rows (doc_id, ordinal, start, mention, type, id), moved to where the mentions stand."""
    placed = spans.reanchor(found.withColumn("end", F.lit(0)), contents(docs)).where("error IS NULL")
    return placed.select(
        "doc_id", F.lit("mutation").alias("etype"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        F.lit(None).cast("double").alias("score"), "mention", F.col("type").alias("mutation_type"), F.col("id").alias("normalized_name"),
    )


def entities(docs: DataFrame, tagger: TokenTagger = gazetteer_tagger, found: DataFrame | None = None, denied: list[str] | None = None) -> DataFrame:
    """COLUMNS of all documents (doc_id, title, abstract): the tagger's entities, of rivals on one span the best, without
    everyday words for species, and the mutations ``found``; ordinal counts a document's entities of a type by place.
    """
    decoded = tagging.decode_runs(tagger(segment.sentences(spread(docs))), mentions=True).repartition("doc_id")  # serves all windows and joins below
    runs = tagging.drop_common_species(tagging.resolve(decoded), tagging.HUMAN_WORDS if denied is None else denied)
    none = F.lit(None).cast("string")
    placed = runs.select("doc_id", "etype", "start", "end", "score", "mention", none.alias("mutation_type"), none.alias("normalized_name"))
    if found is not None:
        placed = placed.unionByName(mutations(docs, found))
    nth = F.row_number().over(Window.partitionBy("doc_id", "etype").orderBy("start", "end")) - 1
    return placed.withColumn("ordinal", nth).select(*COLUMNS)


def normalize(found: DataFrame, registry: Registry) -> DataFrame:
    """The entities with ids, each type by its own normalizer."""
    unknown = found.where(~F.col("etype").isin(*registry.normalizers)).withColumn("ids", F.array(F.lit(dic.UNKNOWN)))
    for etype, normalizer in registry.normalizers.items():
        unknown = unknown.unionByName(normalizer(found.where(F.col("etype") == etype)).select(*COLUMNS, "ids"))
    return unknown


def annotations(docs: DataFrame, registry: Registry, found: DataFrame | None = None, requests: Column | None = None, compat: bool = True) -> DataFrame:
    """COLUMNS and ids of all entities, patterns included.

    Where a whole request has no entity, its texts get no patterns either, unless ``compat`` is off; ``requests`` names the
    request of a document and is its doc_id if it isn't given.
    """
    tagged = materialise(entities(docs, registry.tagger, found), "entities")  # read once for each type
    out, texts = normalize(tagged, registry), contents(spread(docs))
    busy = tagged.select("doc_id").distinct()
    if requests is not None:
        asked = docs.select("doc_id", requests.alias("request"))
        busy = asked.join(asked.join(busy, "doc_id", "left_semi").select("request").distinct(), "request", "left_semi").select("doc_id")
    empty = {"score": F.lit(None).cast("double")} | {c: F.lit(None).cast("string") for c in ("mutation_type", "normalized_name")}
    for etype, pattern in registry.patterns.items():
        rows = pattern(texts).withColumns({"etype": F.lit(etype), **empty})
        rows = rows.join(busy, "doc_id", "left_semi") if compat else rows  # the mentions, not the texts, are joined
        out = out.unionByName(rows.select(*COLUMNS, "ids"))
    return out


def annotate(
    docs: DataFrame, registry: Registry, found: DataFrame | None = None, project: str = "lexiloom", requests: Column | None = None, compat: bool = True,
    elapsed: Column | None = None, stamp: Column | None = None, indent: bool = False,
) -> DataFrame:
    """doc_id and annotation JSON of every document."""
    title = F.col("title")
    shown = docs.select("doc_id", T.shown_content(title, F.col("abstract")).alias("text"), F.when(title.isNull(), "").otherwise("PubMed").alias("sourcedb"))
    return formats.annotation_json(shown, annotations(docs, registry, found, requests, compat), project, elapsed=elapsed, stamp=stamp, indent=indent)
