"""Exact dedup of 64-bit ids beside null ones, and licence rules on pumped texts."""

import time

import pytest

from lexiloom.llm import exact_dedup, license_scan


@pytest.mark.parametrize("null_in_history", [True, False])
def test_exact_dedup_of_large_ids_beside_null_ones(spark, null_in_history):
    """Ids over 2**53 keep their last bits though a null id is in the same shard, on either side."""
    from pyspark.sql import functions as F

    first = (1 << 60) + 1
    rows = [(first + i, f"text {i // 2}") for i in range(600)] + [(None, f"nameless {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    side = F.col("doc_id").isNull() if null_in_history else F.col("doc_id").isNotNull() & (F.col("doc_id") % 2 == 0)
    got = exact_dedup.dedup(df, side).collect()
    named = [r for r in got if r.doc_id is not None]
    assert len(got) == 1_200 and all(r.keep_id == r.doc_id + (r.doc_id - first + 1) % 2 and r.group_size == 2 for r in named)
    assert sum(r.kept for r in got) == 900 and sum(r.kept for r in named) == 300
    assert exact_dedup.keep_one(df).count() == 900


MIT = """permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "software"), to deal
in the software without restriction, including the rights to use and copy, and
to permit persons to whom the software is furnished to do so.
the software is provided"""


def test_license_texts_at_any_indent():
    license_scan.scan(MIT)
    for n in range(41):
        start = time.perf_counter()
        labels = license_scan.scan(MIT.replace("\n", "\n" + " " * n))[5]
        assert labels == "mit-0" and time.perf_counter() - start < 0.05


def test_license_rules_take_no_time_on_pumped_texts():
    """Every rule on its keyword followed, and led, by 100,000 characters of white space, of words and of itself."""
    size, slow = 100_000, []
    for i, rule in enumerate(license_scan.rules()):
        key = max(rule.keywords, key=lambda k: (len(k), k))
        for pump in (" ", "\t", "\n", " \n", "x", "x ", key, key + " ", key + "/"):
            run = pump * (size // len(pump))
            for text in (key + run, run + key, key + " " + run + " " + key):
                start = time.perf_counter()
                license_scan.candidates(text, [i])
                if time.perf_counter() - start > 1:
                    slow.append((rule.label, rule.form, pump))
    assert not slow


def test_license_tag_lines_end_with_the_line():
    found = lambda t: license_scan.scan(t)[5]
    assert found("SPDX-License-Identifier:  \t MIT   OR  \t ISC") == "isc,mit"
    assert found("SPDX-License-Identifier: MIT  \n  OR ISC") == "mit"


def test_chat_rows_without_an_id_are_conversations_of_their_own(spark):
    from lexiloom.llm import chat_format

    rows = [(None, i, "user", f"text {i % 3}") for i in range(90)] + [(1, 1, "assistant", "b"), (1, 0, "user", "a")]
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = made.selectExpr("conv_id", "size(segments) AS n", "valid").groupBy("conv_id", "n", "valid").count().collect()
    assert {(r.conv_id, r.n, r["count"]) for r in got} == {(None, 3, 90), (1, 6, 1)}
