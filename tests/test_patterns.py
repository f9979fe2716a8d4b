import random
import re
import time

from lexiloom.operators import dictionaries as dic
from lexiloom.operators import patterns


def spans_of(spark, texts, tag):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    found = {}
    for r in sorted(tag(df).collect(), key=lambda r: (r["doc_id"], r["ordinal"])):
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["mention"]
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    return [found.get(i, []) for i in range(len(texts))]


def test_mirna_vectors(spark):
    texts = {
        "miR-7": [], "let-7": [], "miR16d": [], "émiR-21": [], "miR-9*": [], "miR-21": [(0, 6)], "let-7a": [(0, 6)], "miR-146a-5p": [(0, 11)], "miR-16-5p": [(0, 9)],
        "mir-16-1-3p": [(0, 11)], "mmu-miR-21": [(4, 10)], "mmu-21": [(0, 6)], "hsa-miR-155": [(0, 11)], "hsa-let-7b-5p": [(0, 13)], "dme-let-7a": [(4, 10)],
        "miR-9*x": [(0, 6)], "miR-1234": [(0, 8)], "miR-12345": [(0, 9)], "micro rna21": [(0, 11)], "miR-181a-1": [(0, 8)], "\U0001f600 miR-21": [(2, 8)],
        "m\u0131R-21": [(0, 6)], "": [],
    }
    assert spans_of(spark, list(texts), patterns.tag_mirna) == list(texts.values())


def test_mirna_equals_all_alternatives_in_turn(spark):
    """Every prefix with every suffix, tried at every place, against the gated and factored search."""
    plain = re.compile("|".join(rf"\b{p}[0-9]{{1,3}}{s}\b" for p in patterns.PREFIXES for s in patterns.SUFFIXES), re.IGNORECASE)
    rng = random.Random(3)
    parts = [*patterns.PREFIXES, "1", "2", "12", "123", "a", "-3p", "-5p", "*", "-1", "b-5p", " ", " ", "x", "MIR-", "Let-", "mdv1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    assert spans_of(spark, texts, patterns.tag_mirna) == [[m.span() for m in plain.finditer(t)] for t in texts]


def test_mirna_ids(spark):
    lines = [(0, "1\thsa-mir-21|mmu-mir-21\tMI1"), (1, "2\thsa-let-7a\t"), (2, "3\tmmu-mir-5b\tMI3"), (3, "4\tshort"), (4, "5\tnone\tx"), (5, "6\tmmu-mir-30a\t"), (6, "7\thsa-mir-30c\t")]
    names = dic.parse_mirna(spark.createDataFrame(lines, "line_no int, value string"))
    tagger = patterns.mirna_tagger(names, "P:")
    texts = {"miR-21": ["miRBase:MI1", "P:1"], "let-7a": ["P:2"], "miR-5B": ["miRBase:MI3", "P:3"], "miR-99a": ["P:"], "mir-021": ["miRBase:MI1", "P:1"], "miR-30b": ["P:6"]}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    found = {r["doc_id"]: r["ids"] for r in tagger(df).collect()}
    assert [found.get(i) for i in range(len(texts))] == list(texts.values())


def plain_names(text, names):
    pattern = re.compile("|".join(re.escape(n) for n in names))
    return [m.span() for m in pattern.finditer(text)]


def test_names_equal_an_alternation_in_dictionary_order(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 6))) for _ in range(30)}, key=lambda n: (len(n) % 3, n))
    texts = ["".join(rng.choice("abc \U0001f600") for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    known = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, dict_order int")
    one = spans_of(spark, texts, lambda df: patterns.tag_names(df, known))
    assert one == [plain_names(t, names) for t in texts]


def test_names_in_blocks(spark, monkeypatch):
    names = ["signaling pathway", "HIF-1 signaling pathway", "pathway", "way", "a"]
    known = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, dict_order int")
    texts = ["the HIF-1 signaling pathway a pathway", "away", ""]
    monkeypatch.setattr(patterns, "BLOCK_CHARS", 12)
    assert spans_of(spark, texts, lambda df: patterns.tag_names(df, known)) == [plain_names(t, names) for t in texts]


def test_names_in_odd_tables_and_very_long_words(spark):
    none = spark.createDataFrame([], "name string, dict_order int")
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 1_000_000 + "pathway")], "doc_id int, content string")
    assert patterns.tag_names(df, none).count() == 0
    known = spark.createDataFrame([("pathway", 1), ("pathway", 0), ("", 2)], "name string, dict_order int")
    began = time.time()
    assert [(r["doc_id"], r["start"]) for r in patterns.tag_names(df, known).collect()] == [(3, 1_000_000)]
    assert patterns.tag_mirna(df).count() == 0 and time.time() - began < 10


def test_pathway_dictionary(spark):
    lines = [(0, "7\tHIF-1 signaling\tKEGG:1"), (1, "8\tHIF-1 signaling pathway"), (2, "x"), (3, "9\tWnt pathway\t")]
    names = dic.parse_pathways(spark.createDataFrame(lines, "line_no int, value string"))
    df = spark.createDataFrame([(1, "HIF-1 signaling pathway, Wnt pathway")], "doc_id int, content string")
    found = patterns.pathway_tagger(names, "P:")(df).orderBy("start").collect()
    assert [(r["mention"], r["ids"]) for r in found] == [("HIF-1 signaling pathway", ["KEGG:1", "P:7"]), ("Wnt pathway", ["P:9"])]
