import random
import re
import time

import pytest

from lexiloom.operators import segment


@pytest.mark.parametrize(
    ("text", "pieces"),
    [
        ("One. Two.", ["One.", " Two."]),
        ("p < 0.5 was seen. Next one!", ["p < 0.5 was seen.", " Next one!"]),
        ("a.b c. d. E f", ["a.b c. d.", " E f"]),
        ("Why?Yes! no way.", ["Why?", "Yes!", " no way."]),
        ('Dr. "X" ok. - dash', ["Dr.", ' "X" ok.', " - dash"]),
        ("", []),
    ],
)
def test_sentences(text, pieces):
    assert segment.split_sentences(text) == pieces


def plain_pieces(sentence):
    """The rule of length, word by word: over 100 words, cut 200 raw tokens until the rest has under 100 words."""
    toks = re.findall(r"[0-9a-zA-Z]+|[^0-9a-zA-Z]", sentence)
    count = lambda ts: sum(t != " " for t in ts)
    out = []
    if count(toks) > 100:
        while True:
            out.append("".join(toks[:200]))
            toks = toks[200:]
            if count(toks) < 100:
                break
    out.append("".join(toks))
    return [p for p in out if p]


def test_long_sentences_equal_the_plain_rule():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.choice([5, 99, 100, 101, 150, 199, 200, 201, 299, 400, 777])
        text = "".join(rng.choice(["ab", " ", " ", "é", "x1", ",", "\n"]) + rng.choice(["", " ", "  "]) for _ in range(n))
        assert segment.cut_long(text) == plain_pieces(text)


def test_sentences_and_words_equal_the_plain_rule(spark):
    rng = random.Random(2)
    signs = ["word", "A", " ", " ", ". ", "? ", "!", "é", "\U0001f600", "12", "-", '"', "\n", "longerthantwentycharacters" * 2]
    make = lambda n: "".join(rng.choice(signs) for _ in range(n))
    docs = [(i, rng.choice([None, "", make(10), make(200)]), rng.choice([None, "", "   ", make(5), make(300)])) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, title string, abstract string")
    sents = segment.sentences(df)
    words = {}
    for r in segment.words(sents).collect():
        words.setdefault((r["doc_id"], r["sent_idx"]), []).append((r["word_idx"], r["word"], r["shown"], r["start"], r["end"]))
    seen = set()
    contents = {i: (a or "") if t is None else t + (" " + a if a else "") for i, t, a in docs}
    for r in sents.collect():
        assert contents[r["doc_id"]][r["start"] : r["start"] + len(r["text"])] == r["text"] and r["text"].strip(" ")
        found = [m for m in re.finditer(r"[0-9a-zA-Z]+|[^0-9a-zA-Z]", r["text"]) if m[0] != " "]
        own = [(k, m[0], m[0][:10] if len(m[0]) > 20 else m[0], r["start"] + m.start(), r["start"] + m.end()) for k, m in enumerate(found)]
        assert sorted(words.pop((r["doc_id"], r["sent_idx"]))) == own
        seen.add((r["doc_id"], r["sent_idx"]))
    assert not words and len(seen) > 1000
    for i, content in contents.items():  # nothing but blanks is left out
        kept = sum(len(r["text"]) for r in sents.where(f"doc_id = {i}").collect()) if i < 10 else None
        assert kept is None or len(content.replace(" ", "")) <= kept <= len(content)


def test_long_texts_take_linear_time(spark):
    text = "ab " * 100_000
    df = spark.createDataFrame([(1, None, text)], "doc_id long, title string, abstract string")
    segment.words(segment.sentences(df)).count()
    began = time.time()
    assert segment.words(segment.sentences(df)).count() == 100_000
    assert time.time() - began < 5


def test_odd_tables(spark):
    df = spark.createDataFrame([("x", None, None), ("x", "", ""), (None, "a. B", " "), ("y", None, "z"), ("y", None, "z")], "doc_id string, title string, abstract string")
    rows = sorted((r["doc_id"] or "", r["sent_idx"], r["text"], r["start"]) for r in segment.sentences(df).collect())
    assert rows == [("", 0, "a. B", 0), ("y", 0, "z", 0), ("y", 0, "z", 0)]
    assert segment.words(segment.sentences(df.limit(0))).count() == 0


def test_chunks(spark):
    rows = [(1, 0, " ".join(f"w{i}" for i in range(65)), 0), (1, 1, "é" * 2 + "a" * 21 + " b", 200), (2, 0, None, 0), (2, 0, "", 0), (3, 0, " ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, sent_idx int, text string, start int")
    made = segment.chunks(df)
    found = made.where("sent_idx = 0").orderBy("chunk").collect()
    assert [len(r["words"]) for r in found] == [30, 30, 5] and found[1]["words"][0] == "w30"
    assert made.where("sent_idx = 1").first()["words"] == ["é", "é", "a" * 10, "b"] and made.count() == 4
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
