import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import patterns, segment, tagging
from lexiloom.sources import parsers


def test_words_carry_offsets(spark):
    df = spark.createDataFrame([(1, 0, "réaux  X\nq", 5)], "doc_id long, sent_idx int, text string, start int")
    rows = segment.words(df).orderBy("word_idx").collect()
    assert [(r["word"], r["start"], r["end"]) for r in rows] == [("r", 5, 6), ("é", 6, 7), ("aux", 7, 10), ("X", 12, 13), ("\n", 13, 14), ("q", 14, 15)]


@pytest.mark.parametrize(
    ("tags", "runs"), [("OBIO", [(1, 2)]), ("IIB", [(2, 2)]), ("BBI", [(0, 0), (1, 2)]), ("BOI", [(0, 0)]), ("OII", [])]
)
def test_bio(spark, tags, runs):
    rows = [(1, "gene", 0, i, "word", 5 * i, 5 * i + 4, t, 0.5) for i, t in enumerate(tags)]
    df = spark.createDataFrame(rows, "doc_id int, etype string, sent_idx int, word_idx int, word string, start int, end int, tag string, p double")
    found = tagging.decode(df).orderBy("start").collect()
    assert [(r["first_word"], r["last_word"]) for r in found] == runs


def test_runs_in_order_decode_as_windows_do(spark):
    """Sentences over the borders of batches, gaps, repeated documents, null ids and scores, final words of one character."""
    random = np.random.default_rng(5)
    rows = []
    for doc in [None, *range(60), 7]:
        for etype in ("gene", "drug"):
            for sent in range(3):
                at, again = 0, 100 * (doc == 7) * len([r for r in rows if r[0] == 7 and r[1] == etype and r[2] == sent])
                for i in range(int(random.integers(0, 30))):
                    word = "abcdefgh"[: int(random.integers(1, 4))]
                    tag, p = random.choice(["B", "I", "I", "O"]), None if random.random() < 0.1 else float(random.random())
                    if random.random() < 0.9:
                        rows.append((doc, etype, sent, i + again, word, at, at + len(word), str(tag), p))
                    at += len(word) + int(random.integers(0, 3))
    df = spark.createDataFrame(rows, "doc_id int, etype string, sent_idx int, word_idx int, word string, start int, end int, tag string, p double").coalesce(1)
    shown = lambda found: sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in found.collect())
    expected = shown(tagging.decode(df, mentions=True))
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        made = tagging.decode_runs(df, mentions=True)
        assert shown(made) == expected and len(expected) > 300
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    assert tagging.decode_runs(df.limit(0)).count() == tagging.decode_runs(df.where("tag = 'O'")).count() == 0


def test_mirna(spark):
    texts = {"miR-7": [], "miR-21": [(0, 6)], "mmu-miR-21": [(4, 10)], "hsa-let-7b-5p": [(0, 13)], "miR-181a-1": [(0, 8)], "émiR-21": [], "\U0001f600 miR-21": [(2, 8)]}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    found = {}
    for r in patterns.tag_mirna(df).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert [found.get(i, []) for i in range(len(texts))] == list(texts.values())


def test_scalars(spark):
    df = spark.createDataFrame([("N,N-Di (Me)", "PIK3CA gene", "p.F83S;X:1")], "a string, b string, c string")
    row = df.select(T.drug_key(F.col("a")), T.gene_key(F.col("b")), T.mutation_key(F.col("c"))).first()
    assert tuple(row) == ("nndime", "PIK3CA", "p.F83S")


def test_last_block_without_blank_line_is_lost(spark):
    df = spark.createDataFrame([("1|t|A\n1|a|B\n1\t0\t1\tA\tSNP\tx\n\n2|t|C\n2|a|D\n",)], "value string")
    rows = parsers.pubtator(parsers.blocks(df)).collect()
    assert [(r["doc_id"], r["title"], len(r["annotations"]), r["error"]) for r in rows] == [("1", "A", 1, None)]


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
