"""What the operators of this subpackage share: table reads, shared tables, ASCII case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.tables import discard, materialise, scratch_dir, spread

__all__ = ["ASCII_LOWER", "LOWER", "UPPER", "ascii_lower", "discard", "materialise", "scratch_dir", "spread", "table", "texts"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of ``documents``, for maps that cost more than dealing out a small table."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
