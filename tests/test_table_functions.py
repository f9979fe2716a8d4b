"""Taggers in SQL, numbers of spans against a gold run, repeated mentions, outcomes of requests."""

import pytest

from lexiloom.operators import analytics, patterns, table_functions
from lexiloom.operators import dictionaries as dic
from lexiloom.plans import load

DOCS = [(1, "miR-21a and hsa-let-7b-5p"), (2, "none"), (3, None), (4, ""), (5, "Wnt pathway, HIF-1 signaling, Wnt"), (5, "Wnt pathway, HIF-1 signaling, Wnt")]
NAMES = [("Wnt", 2), ("Wnt pathway", 1), ("HIF-1 signaling", 3), ("", 0)]


def rows(found):
    return sorted(tuple(r[c] for c in ("doc_id", "ordinal", "start", "end", "mention")) for r in found.collect())


def test_taggers_in_sql(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, content string")
    dictionary = spark.createDataFrame(NAMES, "name string, dict_order int")
    made = {
        table_functions.register(spark, "miRNA", table_functions.mirna()): patterns.tag_mirna(docs),
        table_functions.register(spark, "pathway", table_functions.names(dictionary)): patterns.tag_names(docs, dictionary),
    }
    docs.createOrReplaceTempView("tagged_docs")
    for name, expected in made.items():
        expected = rows(expected)
        lateral = spark.sql(f"SELECT d.doc_id, t.* FROM tagged_docs d, LATERAL {name}(d.content) t")
        assert rows(lateral) == expected and len(expected) >= 2
        assert "Exchange" not in lateral._jdf.queryExecution().executedPlan().toString()
        whole = spark.sql(f"SELECT * FROM {name}(TABLE(tagged_docs) PARTITION BY doc_id)")
        assert rows(whole) == expected and dict(whole.dtypes)["doc_id"] == "bigint"
        assert spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM tagged_docs WHERE false) PARTITION BY doc_id)").count() == 0
    with pytest.raises(Exception, match="doc_id and content"):
        spark.sql("SELECT * FROM tag_mirna(TABLE(SELECT content FROM tagged_docs))").collect()
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM tag_mirna(7)").collect()


def test_names_of_a_function_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK_CHARS", 10)
    with pytest.raises(ValueError, match="10 characters"):
        table_functions.names(spark.createDataFrame(NAMES, "name string, dict_order int"))


def test_repeated_mentions_have_their_ids_once(spark):
    m = spark.createDataFrame([(1, "drug", 0, "a|b"), (1, "drug", 0, "a|b"), (None, "drug", 1, "b"), (2, "drug", 0, "CUI-less"), (3, "drug", 0, None)], "doc_id int, etype string, ordinal int, oid string")
    ext = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "oid string, ext_ids array<string>")
    found = sorted((r["doc_id"] or 0, r["ids"] or []) for r in dic.full_ids(m, ext, "P:").collect())
    assert found == [(0, ["z", "P:b"]), (1, ["x", "y", "z", "P:a", "P:b"]), (1, ["x", "y", "z", "P:a", "P:b"]), (2, ["CUI-less"]), (3, [])]


def test_numbers_of_spans_against_gold(spark):
    schema = "doc_id int, etype string, ordinal int, start int, end int"
    a = spark.createDataFrame([(1, "gene", 0, 0, 1), (1, "gene", 1, 3, 4), (2, "drug", 0, 0, 1), (None, "gene", 0, 0, 1)], schema)
    b = spark.createDataFrame([(1, "gene", 0, 0, 1), (2, "drug", 0, 5, 6), (2, "gene", 0, 5, 6), (None, "gene", 0, 0, 1)], schema)
    assert sorted(tuple(r) for r in analytics.compare_counts(a, b).collect()) == [(1, "gene", 2, 1), (2, "gene", 0, 1)]
    assert analytics.compare_counts(a.limit(0), b.limit(0)).count() == 0


def test_outcomes_of_requests(spark):
    texts = [(None, None), ("x out of index range", 1.0), ("x BioC.key y", None), ("error: z", None), ("error: z", 1.0), ("fine", None), ("fine", 2.0)]
    found = dict(load.outcomes(spark.createDataFrame(texts, "text string, elapsed_time double")).collect())
    assert found == {load.NO_OBJECT: 1, load.NO_RANGE: 1, load.NOT_AVAILABLE: 1, "error: z": 1, load.NO_TIMES: 1, load.DONE: 2}
