"""The training-data pipeline over ``documents``: toxicity, exact dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every stage's
result as Parquet into the shared folder and reads it again as the next one's input.  What a stage wrote on its way is
removed when its result is written, and a result when the next one is.  Stages called alone set BATCH in the session,
since their results are made when the caller writes them; ``run`` sets it back.

Results for odd input: null texts are empty texts, null ids never match another row, empty tables give no rows;
columns beyond those of ``documents`` are dropped, so that no name can clash with those a stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from lexiloom.llm.common import materialise, table
from lexiloom.tables import discard, spread, temporary

#: Rows of an Arrow batch.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express a trained score, fuzzy fingerprints or a latent space; tests hold each stage against brute force.
ORACLE_SQL = None


def _bounded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches set to BATCH_ROWS rows: a batch lies whole in the memory of the JVM and
    of Python, and texts are long."""
    spark.conf.set(BATCH, BATCH_ROWS)
    return docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose score is under the threshold; the model is fitted on labelled rows of ``docs``."""
    return toxicity.keep_clean(_bounded(spark, docs).select(COLUMNS), table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts the row with the largest doc_id."""
    return exact_dedup.keep_one(_bounded(spark, docs).select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of similar texts (shingles of five words, similarity 0.8) the smallest doc_id."""
    return simhash.keep_one(_bounded(spark, docs).select(COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no item of the benchmark."""
    return decontaminate.drop_leaks(_bounded(spark, docs).select(COLUMNS), table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and whether they decode to the text."""
    return bpe.tokens(_bounded(spark, docs).select("doc_id", "text", "lang", "source"), keep=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs, before = spread(table(spark, sf_dir, "documents")), spark.conf.get(BATCH, None)
    try:
        for name, stage in STAGES:
            with temporary(f"pipeline-{name}"):
                made = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            discard(docs)
            docs = made
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)
    return docs
