"""Running sums and numbers over a whole table in one order, without bringing all rows into one task.

The rows are dealt into ranges of the order's first column by bounds from a bounded sample, which steer the work and not the result;
each range has its own window, and the sums of the ranges before it are added.  Rows of one first value stay in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range about, and values that the bounds are taken from at most.
RANGE_ROWS, SAMPLE = 1_000_000, 20_000


def bounds(rows: DataFrame, column: str, range_rows: int = RANGE_ROWS) -> list:
    """Ascending values that cut the rows into ranges of about ``range_rows``."""
    n = rows.count()
    ranges = -(-n // range_rows)
    if ranges < 2:
        return []
    sample = rows.select(column).where(F.col(column).isNotNull()).sample(min(1.0, SAMPLE / n), seed=5).limit(2 * SAMPLE)
    values = sorted(r[0] for r in sample.collect())
    return sorted({values[len(values) * i // ranges] for i in range(1, ranges)}) if values else []


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the sum of ``value`` over all rows up to this one; nulls of the order come first, rows equal in it in any order."""
    cuts = bounds(rows, order[0], range_rows)
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order[0]))) if cuts else F.lit(0)
    dealt = rows.withColumns({"__value": value, "__range": F.when(F.col(order[0]).isNull(), 0).otherwise(at)})
    sums = {r[0]: r[1] for r in dealt.groupBy("__range").agg(F.sum("__value")).collect()}  # one row a range
    before = [sum(v or 0 for k, v in sums.items() if k < i) for i in range(len(cuts) + 1)]
    window = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("__value").over(window) + F.element_at(F.array(*[F.lit(b) for b in before]), F.col("__range") + 1)
    return dealt.withColumn(name, total).drop("__value", "__range")


def numbered(rows: DataFrame, order: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the number of each row in the order, from 0."""
    return running_sum(rows, order, F.lit(1).cast("long"), name, range_rows).withColumn(name, F.col(name) - 1)
