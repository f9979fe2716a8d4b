import random
import time

import numpy as np
import pytest

from lexiloom.operators import plugins, segment, subword, tagging

VOCABULARY = subword.vocabulary_of(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "a", "##b", "##bc", "ab", ",", "中", "b", "##a", "x"])


@pytest.mark.parametrize(
    ("text", "lower", "tokens"),
    [
        ("Hello, World!", False, ["Hello", ",", "World", "!"]),
        ("  a\u00a0b\tc\r\n", False, ["a", "b", "c"]),
        ("a\x00b\ufffdc\u200dd", False, ["abcd"]),
        ("x中文y", False, ["x", "中", "文", "y"]),
        ("Élan–vital", True, ["elan", "–", "vital"]),
        ("p.Phe83Ser", False, ["p", ".", "Phe83Ser"]),
        ("", False, []),
    ],
)
def test_basic_tokens(text, lower, tokens):
    assert subword.basic_tokens(text, lower) == tokens


def plain_pieces(token, vocabulary):
    """Greedy search that shortens the end one character at a time."""
    out, start = [], 0
    while start < len(token):
        end = len(token)
        while end > start and ("##" if start else "") + token[start:end] not in vocabulary:
            end -= 1
        if end == start:
            return ["[UNK]"]
        out.append(("##" if start else "") + token[start:end])
        start = end
    return out


def test_pieces():
    assert subword.pieces("unaffable", VOCABULARY) == ["un", "##aff", "##able"]
    assert subword.pieces("unq", VOCABULARY) == ["[UNK]"] == subword.pieces("a" * 201, VOCABULARY)
    rng = random.Random(5)
    for _ in range(2000):
        token = "".join(rng.choice("abcxun") for _ in range(rng.randrange(1, 9)))
        assert subword.pieces(token, VOCABULARY) == plain_pieces(token, VOCABULARY)


def test_lookups():
    assert subword.vocabulary_of(["a", "b", "a"]) == {"a": 2, "b": 1}
    assert subword.to_tokens(subword.to_ids(["un", "##aff"], VOCABULARY), VOCABULARY) == ["un", "##aff"]
    with pytest.raises(KeyError):
        subword.to_ids(["nowhere"], VOCABULARY)


def test_example_is_cut_and_padded():
    x = subword.example(["unaffable", "\x00", "ab", "a"], ["B", "I", "O", "I"], VOCABULARY, 8)
    assert x.tokens == ["[CLS]", "un", "##aff", "##able", "ab", "a", "[SEP]", "**NULL**"]
    assert x.labels == [5, 1, 4, 4, 3, 2, 6, 0] and x.mask == [1] * 7 + [0] and x.segments == [0] * 8 and x.first == [1, -1, 4, 5]
    cut = subword.example(["ab"] * 9, None, VOCABULARY, 6)
    assert cut.tokens == ["[CLS]", "ab", "ab", "ab", "ab", "[SEP]"] and cut.first == [1, 2, 3, 4, -1, -1, -1, -1, -1]


def test_examples_of_chunks(spark):
    docs = spark.createDataFrame([(1, None, "ab, unaffable " * 20), (2, None, "")], "doc_id long, title string, abstract string")
    vocabulary = spark.createDataFrame(list(VOCABULARY.items()), "token string, id int")
    rows = subword.examples(segment.chunks(segment.sentences(docs)), vocabulary, 64).orderBy("chunk").collect()
    words = ["ab", ",", "unaffable"] * 20
    for r in rows:
        own = subword.example(words[r["chunk"] * 30 : r["chunk"] * 30 + 30], None, VOCABULARY, 64)
        assert (r["input_ids"], r["input_mask"], r["segment_ids"], r["label_ids"], r["tokens"]) == (own.ids, own.mask, own.segments, own.labels, [t for t in own.tokens if t != subword.PADDING])
    assert len(rows) == 2


def test_model_tagger(spark):
    """A model that opens a mention at every word in capitals and goes on with digits; it is loaded once a worker."""

    def load(etype):
        def model(examples):
            out = []
            for words in examples:
                assert len(words) <= segment.CHUNK_WORDS
                scores = np.full((len(words), plugins.CLASSES), -9.0)
                for i, w in enumerate(words):
                    scores[i, 1 if w.isupper() and etype == "gene" else 2 if w.isdigit() else 3] = 0
                out.append(scores)
            return out

        return model

    text = "the ABC 12 of x. DEF " + "w " * 40 + "GHI 3 4 end"
    docs = spark.createDataFrame([(1, None, text), (2, None, "")], "doc_id long, title string, abstract string")
    tags = plugins.model_tagger(load)(segment.sentences(docs))
    found = tagging.decode(tags, mentions=True).orderBy("start").collect()
    assert [(r["etype"], r["mention"]) for r in found] == [("gene", "ABC 12"), ("gene", "DEF"), ("gene", "GHI 3 4")]
    assert all(text[r["start"] : r["end"]] == r["mention"] for r in found)
    assert all(abs(r["score"] - 1 / (1 + 6 * np.exp(-9))) < 1e-9 for r in found)


def test_held_loads_once():
    calls = []
    assert plugins.held("test/one", lambda: calls.append(1) or 5) == plugins.held("test/one", lambda: calls.append(2) or 6) == 5 and calls == [1]


def test_session_model():
    class Session:
        def run(self, _, feed):
            ids = feed["input_ids"]
            out = np.full((*ids.shape, plugins.CLASSES), -9.0, np.float32)
            out[..., 3] = 0
            out[ids == VOCABULARY["un"], 1] = 5
            return [out]

    scores = plugins.session_model(Session(), VOCABULARY, 8)([["ab", "unaffable"], ["\x00"]])
    tags = [plugins.tag_head(s)[0] for s in scores]
    assert tags == [["O", "B"], ["O"]]


def test_pieces_in_one_pass_equal_the_greedy_rule():
    """Random vocabularies, with marks as characters, pieces that no word can end with, and holes."""
    rng = random.Random(12)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "a#b"])
        string = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
        tokens = {string(5) for _ in range(rng.randrange(0, 8))} | {"##" + string(6) for _ in range(rng.randrange(0, 10))} | set(rng.sample(["##", "##a", "##b", "a", "#"], 2))
        vocabulary = subword.vocabulary_of(sorted(tokens))
        cut = subword.Pieces(vocabulary, short=0)
        for token in ["", *(string(14) for _ in range(30))]:
            assert cut(token) == subword.pieces(token, vocabulary), (token, tokens)


def test_pieces_of_long_tokens_take_linear_time():
    """Long pieces that nearly match at every place: the greedy rule tries all lengths at each."""
    vocabulary = subword.vocabulary_of(["a", "##a", "a" * 150 + "b", "##" + "a" * 150 + "b"])
    cut = subword.Pieces(vocabulary, longest=100_000)
    assert cut("a" * 200) == subword.pieces("a" * 200, vocabulary) == ["a", *["##a"] * 199]
    took = []
    for n in (10_000, 80_000):
        start = time.perf_counter()
        assert len(cut("a" * n)) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 1 and took[1] < 24 * took[0]
    assert cut("a" * 100_001) == [subword.UNKNOWN]
