"""Prefix scans over ranges against plain running statistics."""

import math

import numpy as np
import pytest

from lexiloom.operators import analytics, scan


def plain(rows: list[tuple]) -> dict:
    out, seen = {}, {}
    for key, at, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0)):
        place, values = seen.setdefault(key, [0, []])
        values += [v] if v is not None else []
        x = np.array(values)
        stats = (x.mean(), x.std(), x.min(), x.max()) if len(x) else (None,) * 4
        out[key, at] = (place, len(values), *stats)
        seen[key][0] += 1
    return out


@pytest.mark.parametrize("range_rows", [7, 40, 10_000])
def test_running_equals_a_plain_loop(spark, range_rows):
    """A key with most rows, a null key, null orders and values, keys within a range and over many."""
    rng = np.random.default_rng(range_rows)
    rows = [("hot", i, None if i % 9 == 0 else float(rng.normal(1e6, 3))) for i in rng.permutation(300).tolist()]
    rows += [(None, i, float(i)) for i in range(25)] + [("late", i, None if i < 20 else 1.5) for i in range(30)] + [("none", i, None) for i in range(20)]
    rows += [(f"k{i}", 1, float(i)) for i in range(30)] + [("hot", None, 4.0)]
    df = spark.createDataFrame(rows, "stage string, at long, seconds double").repartition(3)
    got = scan.running(df, "stage", "at", "seconds", range_rows).collect()
    expected = plain(rows)
    assert len(got) == len(rows) == len(expected)
    for r in got:
        place, n, *stats = expected[r.stage, r["at"]]
        assert (r.place, r.n) == (place, n)
        for mine, theirs in zip((r["mean"], r["std"], r.low, r.high), stats, strict=True):
            assert mine is theirs is None or math.isclose(mine, theirs, rel_tol=1e-12, abs_tol=1e-6)


def test_one_stage_is_spread_over_ranges(spark):
    rows = spark.range(5_000).selectExpr("'one' as stage", "id as at", "cast(id % 13 as double) as seconds")
    ranges = scan.dealt(rows, "stage", "at", 250)
    sizes = [r["count"] for r in ranges.groupBy("__range").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 1_000
    assert scan.carried(ranges, "stage", "seconds").count() == len(sizes) - 1
    lines = analytics.log_line_stats(rows, "at", 1_000, 250).collect()
    assert sorted((r.n, round(r["mean"], 9)) for r in lines) == [(n, round(sum(i % 13 for i in range(n)) / n, 9)) for n in range(1_000, 5_001, 1_000)]


def test_running_of_no_rows(spark):
    nothing = spark.createDataFrame([], "stage string, at long, seconds double")
    assert scan.running(nothing, "stage", "at", "seconds").count() == 0 and analytics.log_line_stats(nothing, "at", 5).count() == 0
