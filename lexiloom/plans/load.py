"""Load runs: a sample of documents, in batches if asked, through the plan's stages with their times.

The sample and its batches are the feature: a run times requests, it does not annotate a corpus.  A batch whose plan fails gives
one row with its error; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import analytics
from lexiloom.operators.plugins import Registry
from lexiloom.plans import annotate, formats
from lexiloom.sources.parsers import batches
from lexiloom.tables import materialise, temporary

STAGES = ("ner", "normalization", "total")
SCHEMA = "run int, stage string, seconds double, n_documents long, error string"


def timed(step: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    began = time.perf_counter()
    made = step()
    return made, time.perf_counter() - began


def one_run(docs: DataFrame, registry: Registry) -> dict[str, float]:
    """Seconds of tagging, of normalising (patterns included) and of all, the written form included."""
    began = time.perf_counter()
    with temporary():
        found, ner = timed(lambda: materialise(annotate.entities(docs, registry.tagger), "load-entities"))
        named, normalization = timed(lambda: materialise(annotate.normalize(found, registry), "load-named"))
        shown = docs.select("doc_id", F.col("abstract").alias("text"))
        formats.annotation_json(shown, named, "load").write.format("noop").mode("overwrite").save()
    return dict(zip(STAGES, (ner, normalization, time.perf_counter() - began), strict=True))


def runs(docs: DataFrame, registry: Registry, n: int, seed: int, size: int = 1) -> DataFrame:
    """Rows (SCHEMA) of ``n`` documents (doc_id, title, abstract) drawn by the seed, in batches of ``size``."""
    drawn = batches(analytics.sampled(docs.select("doc_id"), n, seed), "doc_id", size).select("doc_id", F.col("batch").alias("__batch"))
    chosen = materialise(docs.join(drawn, "doc_id"), "load-sample")
    out = []
    for row in chosen.groupBy("__batch").count().orderBy("__batch").collect():  # as many as the caller asked for
        mine = chosen.where(F.col("__batch") == row["__batch"]).drop("__batch")
        try:
            out += [(row["__batch"], stage, s, row["count"], None) for stage, s in one_run(mine, registry).items()]
        except Exception as e:  # a failing request is a result of the run
            out.append((row["__batch"], None, None, row["count"], f"{type(e).__name__}: {str(e)[:200]}"))
    return docs.sparkSession.createDataFrame(out, SCHEMA)


def summary(rows: DataFrame, size: int = 1) -> DataFrame:
    """Statistics a document by stage, of the runs without an error."""
    return analytics.run_stats(rows.where("error IS NULL"), "seconds", ["stage"], size)


#: What became of a request, in the order in which they are looked for; errors are classes of their own text.
NO_RANGE, NOT_AVAILABLE, NO_TIMES, DONE, NO_OBJECT = "out of range", "not available", "no times", "done", "no object"


def outcomes(answers: DataFrame) -> DataFrame:
    """outcome and n of answers (text; elapsed_time, null where an answer has none): which kind of error, or none.

    A null text is an answer that is no object.
    """
    untimed = F.col("elapsed_time").isNull()
    kind = (
        F.when(F.col("text").isNull(), NO_OBJECT).when(F.col("text").contains("out of index range"), NO_RANGE).when(F.col("text").contains("BioC.key"), NOT_AVAILABLE)
        .when(F.col("text").contains("error: ") & untimed, F.col("text")).when(untimed, NO_TIMES).otherwise(DONE)
    )
    return answers.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))
