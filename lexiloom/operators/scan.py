"""Cumulative statistics of a table in one order for each key: a distributed prefix scan over mergeable moments.

The rows are dealt into ranges of (key, order) and written with their range's number.  Each range gives the moments (rows, count, sum,
sum of squares about the mean, least, most) of each key in it; of the keys that several ranges hold, the moments of all earlier
ranges are merged, one small row a range; and each range finishes alone, from what came before.  So a key that all rows have is
spread over all tasks, and nothing but moments passes between them.

Results for odd input: null keys are a key; rows with a null order come last; null values count as rows, not as values, and before
the first value all but the number of values is null; rows of equal key and order may stand in any order, but stay in one range; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.tables import materialise

#: Rows of a range about.
RANGE_ROWS = 200_000

#: Moments of some rows: their number, the number of values, their sum, the sum of squares about their mean, the extremes.
MOMENTS = ("rows", "n", "total", "spread", "low", "high")


def dealt(rows: DataFrame, key: str, order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with __range, ascending in (key, order); keys and orders keep their ranges however often the result is read."""
    ranges = max(1, -(-rows.count() // range_rows))
    one = rows.repartitionByRange(ranges, F.col(key).asc_nulls_last(), F.col(order).asc_nulls_last())
    return materialise(one.withColumn("__range", F.spark_partition_id()), "ranges")


def moments(value: Column) -> list[Column]:
    """MOMENTS as aggregates; the spread of no value is zero."""
    n, v = F.count(value), value.cast("double")
    return [
        F.count("*").alias("rows"), n.alias("n"), F.sum(v).alias("total"),
        F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias("spread"), F.min(value).alias("low"), F.max(value).alias("high"),
    ]


def merged(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Moments of two sets of rows together; those of ``a`` are null where there is no such set."""
    na, nb = F.coalesce(a["n"], F.lit(0)), b["n"]
    apart = F.when((na > 0) & (nb > 0), F.pow(b["total"] / nb - a["total"] / na, F.lit(2.0)) * na * nb / (na + nb)).otherwise(0.0)
    return {
        "rows": F.coalesce(a["rows"], F.lit(0)) + b["rows"],
        "n": na + nb,
        "total": F.when(na == 0, b["total"]).when(nb == 0, a["total"]).otherwise(a["total"] + b["total"]),
        "spread": F.coalesce(a["spread"], F.lit(0.0)) + b["spread"] + apart,
        "low": F.least(a["low"], b["low"]),
        "high": F.greatest(a["high"], b["high"]),
    }


def carried(ranges: DataFrame, key: str, value: str) -> DataFrame:
    """__range, __key and ``before`` (MOMENTS of the key in all earlier ranges), for the ranges that have any.

    A range begins and ends with a key that others may share, so there is at most one row for each range and its first key.
    """
    each = ranges.groupBy("__range", F.col(key).alias("__key")).agg(*moments(F.col(value)))
    spans = Window.partitionBy("__key")
    shared = each.withColumn("__ranges", F.count("*").over(spans)).where("__ranges > 1").drop("__ranges")
    earlier = spans.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    list_ = F.collect_list(F.struct(*MOMENTS)).over(earlier)
    start = F.struct(*[F.lit(None).cast(shared.schema[c].dataType).alias(c) for c in MOMENTS])
    put = lambda acc, x: F.struct(*[c.alias(k) for k, c in merged({k: acc[k] for k in MOMENTS}, {k: x[k] for k in MOMENTS}).items()])
    return shared.select("__range", "__key", F.aggregate(list_, start, put).alias("before")).where("before.rows > 0")


def running(rows: DataFrame, key: str, order: str, value: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with place (from 0), n, mean, std (population), low and high of ``value`` over the key's rows up to this one."""
    ranges = dealt(rows, key, order, range_rows)
    before = materialise(carried(ranges, key, value), "range-moments")
    same = (F.col("__range") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key"))
    both = ranges.join(before.withColumnRenamed("__range", "__of"), same, "left")
    local = Window.partitionBy("__range", key).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    own = dict(zip(MOMENTS, [x.over(local) for x in (F.count("*"), F.count(value), F.sum(F.col(value).cast("double")))], strict=False))
    own |= {"spread": F.coalesce(F.var_pop(value).over(local) * F.count(value).over(local), F.lit(0.0)), "low": F.min(value).over(local), "high": F.max(value).over(local)}
    both = both.withColumns({f"__{k}": c for k, c in own.items()} | {"__mean": F.avg(value).over(local), "__std": F.stddev_pop(value).over(local)})
    all_ = merged({k: F.col(f"before.{k}") for k in MOMENTS}, {k: F.col(f"__{k}") for k in MOMENTS})
    first = F.col("before").isNull()  # nothing to merge: Spark's own mean and deviation
    some = all_["n"] > 0
    return both.select(
        *[F.col(f"`{c}`") for c in rows.columns], (all_["rows"] - 1).alias("place"), all_["n"].alias("n"),
        F.when(first, F.col("__mean")).when(some, all_["total"] / all_["n"]).alias("mean"),
        F.when(first, F.col("__std")).when(some, F.sqrt(all_["spread"] / all_["n"])).alias("std"),
        all_["low"].alias("low"), all_["high"].alias("high"),
    )
