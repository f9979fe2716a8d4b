"""Arrays of words are cut as single words are, and each distinct word once."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.operators import plugins, subword

TOKENS = [subword.UNKNOWN, subword.FIRST, subword.LAST, "a", "b", "##a", "##b", "ab", "##aba", "é", "-", "aaaaaaaaaaaaaaaaaaaab"]
VOCABULARY = {t: i % 7 + 1 for i, t in enumerate(TOKENS)}  # several tokens have one id


def some_examples(rng):
    word = lambda: rng.choice(["", "\x00", "x", "A", "é", "a-b", "a" * 300, "a" * 20 + "b"]) if rng.random() < 0.3 else "".join(rng.choice("ab") for _ in range(rng.randrange(1, 30)))
    return [[word() for _ in range(rng.choice([0, 1, 3, 12]))] for _ in range(rng.randrange(1, 9))]


@pytest.mark.parametrize("lower", [False, True])
def test_arrays_are_laid_as_single_examples(lower):
    rng, encoder = random.Random(4), subword.Encoder(VOCABULARY, lower)
    for _ in range(200):
        examples, length = some_examples(rng), rng.choice([3, 8, 40])
        starts = np.append(0, np.cumsum([len(x) for x in examples])).astype(np.int64)
        laid = encoder.lay(pa.array([w for x in examples for w in x], pa.string()), starts, length)
        ids, mask = encoder.ids_of(laid, np.arange(len(examples)), length)
        for i, words in enumerate(examples):
            own = subword.example(words, None, VOCABULARY, length, lower)
            assert ids[i].tolist() == own.ids and mask[i].tolist() == own.mask and laid.first[starts[i] : starts[i + 1]].tolist() == own.first


def test_models_of_one_encoder_cut_each_distinct_word_once(monkeypatch):
    cut = []
    monkeypatch.setattr(subword, "basic_tokens", lambda text, lower=False: cut.append(text) or [text])

    class Session:
        def run(self, _, feed):
            return [np.eye(plugins.CLASSES)[feed["input_ids"] % plugins.CLASSES]]

    encoder = subword.Encoder(VOCABULARY)
    for _ in range(2):
        model = plugins.session_model(Session(), encoder, 20)
        assert len(model([["ab", "ba", "ab"] * 3, ["ba"] * 5])[1]) == 5
    assert sorted(cut) == ["ab", "ba"]
    words = pa.array(["ab", "ba"])
    assert encoder.lay(words, np.array([0, 2]), 20) is encoder.lay(words, np.array([0, 2]), 20)


def test_short_tokens_are_looked_up_by_lengths_that_tokens_have():
    class Counted(dict):
        asked = 0

        def __contains__(self, token):
            self.asked += 1
            return super().__contains__(token)

    vocabulary = Counted({"a": 1, "##a": 2, "##b": 3})
    cut = subword.Pieces(vocabulary)
    assert cut("abababababababab") == subword.pieces("abababababababab", dict(vocabulary)) and vocabulary.asked <= 18


def test_basic_tokens_of_a_batch_are_made_in_parts(spark, monkeypatch):
    """Texts of a batch go to Python's strings a part at a time; nulls stay, parts come back in order, sliced or not."""
    from pyspark.sql import functions as F

    texts = [None, "", "a-b"] + [f"word {i} " * 3 for i in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    made = rows.select("i", subword.basic(F.col("t")).alias("x"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString() and "arrow" in str(subword.basic.__code__.co_names)
    assert {r["i"]: r["x"] for r in made.collect()} == {i: None if t is None else subword.basic_tokens(t) for i, t in enumerate(texts)}


def test_examples_can_be_used_where_they_are_made(spark):
    chunks = spark.createDataFrame([(i, 0, 0, ["ab"] * (i % 9), ["B"] * (i % 9)) for i in range(1200)], "doc_id long, sent_idx int, chunk int, words array<string>, labels array<string>")
    vocabulary = spark.createDataFrame(list(VOCABULARY.items()), "token string, id int")

    def sizes(made):
        n = [len(x) for x in made["tokens"].to_pylist()]
        b = [sum(y == 1 for y in x) for x in made["label_ids"].to_pylist()]
        return pa.RecordBatch.from_arrays([made["doc_id"], pa.array(n), pa.array(b)], ["doc_id", "n", "b"])

    got = subword.examples(chunks, vocabulary, 8, then=sizes, schema="doc_id long, n long, b long").collect()
    assert {r["doc_id"]: (r["n"], r["b"]) for r in got} == {i: (min(i % 9, 6) + 2, min(i % 9, 6)) for i in range(1200)}
