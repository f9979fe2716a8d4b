import json

from lexiloom.sources import parsers


def test_blocks_and_errors(spark):
    text = (
        "1|t|A\n1|a|B b\n1\t0\t1\tA\tSNP\tx\n1\t2\t3\tB\tGene\ty\n\n2|t|- No text -\n2|a|-NoAbstract-\n\n3 t C\n3|a|D\n\n4|t|E\n4|a|F\n4\t1\n\n5|t|G\n6|a|H\n\n7|t|lost\n7|a|I\n"
    )
    blocks = parsers.blocks(spark.createDataFrame([(text,)], "value string"))
    rows = parsers.pubtator(blocks, parsers.ALLOWED, check_ids=True).collect()
    assert [(r["doc_id"], r["title"], r["abstract"], r["error"]) for r in rows] == [
        ("1", "A", "B b", None), ("2", "", "", None), ("3 t C", None, "D", "bad title line"), ("4", "E", "F", "bad annotation line"), ("5", "G", "H", "ids differ"),
    ]
    assert [(a["mention"], a["type"]) for a in rows[0]["annotations"]] == [("A", "SNP")]
    raw = parsers.pubtator(spark.createDataFrame([("9|t|the text\n9|a|",)], "value string"), raw=True).first()
    assert raw["title"] is None and raw["abstract"] == "the text"


def test_annotation_objects(spark):
    text = "1|t|A\n1|a|B\n1\t0\t1\tA\tGene\tx|y\n\n"
    row = parsers.annotation_objects(parsers.pubtator(parsers.blocks(spark.createDataFrame([(text,)], "value string")))).first()
    assert row["text"] == "A B" and [(d["obj"], d["id"], d["span"]["begin"], d["span"]["end"]) for d in row["denotations"]] == [("Gene", ["x", "y"], 0, 1)]


BIOC = """<collection><document><id>007</id><passage><infon key="type">title</infon><offset>0</offset><text>One &amp; two</text></passage>
<passage><infon key="type">abstract</infon><offset>9</offset><text>first</text></passage><passage><infon key="type">abstract</infon><offset>9</offset><text>the last{}</text>
<annotation><infon key="identifier">p.1</infon><infon key="type">SNP</infon><location offset="9" length="3"/><text>the</text></annotation>
<annotation><infon key="identifier">q</infon><infon key="type">Gene</infon><location offset="9" length="3"/><text>the</text></annotation></passage></document>
<document><id>8</id></document></collection>"""


def test_bioc_texts(spark, tmp_path):
    """References are resolved; where that breaks the XML the text is read as it came; unreadable answers give nothing."""
    df = spark.createDataFrame([(1, BIOC.format("")), (2, BIOC.format(" a &amp;lt; b")), (3, "<collection><docu"), (4, None)], "n int, value string")
    rows = parsers.bioc_documents(parsers.bioc_texts(df.where("n = 2"))).collect()
    assert [(r["doc_id"], r["title"], r["abstract"]) for r in rows] == [("007", "One & two", "the last a &lt; b"), ("8", "", "")]
    assert [(a["start"], a["end"], a["mention"], a["type"], a["id"]) for a in rows[0]["annotations"]] == [(9, 12, "the", "SNP", "p.1")]
    assert parsers.bioc_texts(df.where("n > 2")).count() == 0
    (tmp_path / "a.xml").write_text(BIOC.format(""))
    found = parsers.bioc_documents(parsers.bioc(spark, f"file://{tmp_path}/a.xml")).collect()
    assert sorted(r["doc_id"] for r in found) == ["007", "8"]


def test_articles(spark):
    xml = "<S><PMID>5</PMID><ArticleTitle>T &lt;1&gt;</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText><CopyrightInformation>c</CopyrightInformation></Abstract></S>"
    book = "<S><PMID>6</PMID><BookTitle>B</BookTitle></S>"
    rows = parsers.pubmed(spark.createDataFrame([(xml,), (book,)], "xml string")).collect()
    assert [tuple(r) for r in rows] == [("5", "T <1>", "a b"), ("6", "B", None)]
    full = """<article><front><article-id pub-id-type="pmid">1</article-id><article-id pub-id-type="pmc">2</article-id><article-title>T</article-title>
    <abstract><p>x</p><sec><p>y <b>z</b></p></sec></abstract></front><body><sec><title>no</title><p>p</p><sec><p>q</p></sec></sec></body></article>"""
    row = parsers.pmc(spark.createDataFrame([(full,)], "xml string")).first()
    assert (row["doc_id"], row["title"], row["abstract"].split(), row["body"].split()) == ("2", "T", ["x", "y", "z"], ["p", "q"])


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"pmid": "1", "title": "a b", "abstract": "c\r d"}) + "\nbroken\n")
    rows = parsers.json_lines(spark, f"file://{tmp_path}/a.json").collect()
    assert [tuple(r) for r in rows] == [("1", "a b", "c d"), (None, None, None)]
    one = json.dumps({"sourceid": "3", "text": "t", "denotations": [{"obj": "Mutation:SNP", "span": {"begin": 1, "end": 2}}]})
    row = parsers.tool_json(spark.createDataFrame([(one,), ("{}",)], "value string")).collect()
    assert row[0]["spans"][0].asDict() == {"obj": "SNP", "start": 1, "end": 2} and row[1]["spans"] is None


def test_lists(spark):
    lines = spark.createDataFrame([("a/b.tgz J 2001 PMC1 x",), ("short line",), ("c.tgz\tJ\t2\tPMC2\tx",), ("",)], "value string")
    there = spark.createDataFrame([("c.tgz",)], "file string")
    assert [r["file"] for r in parsers.file_list(lines, there).collect()] == ["a/b.tgz"]
    words = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "line_no int, value string")
    assert {r["token"]: r["id"] for r in parsers.vocabulary(words).collect()} == {"a": 2, "b": 1}
    assert [r["batch"] for r in parsers.batches(spark.range(7), "id", 3, 2).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_text_lines_and_request_order(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1||a\r\n\n2||b")
    assert [tuple(r) for r in parsers.text_lines(spark, f"file://{tmp_path}/d.txt").orderBy("line_no").collect()] == [(0, "1||a"), (2, "2||b")]
    asked = spark.createDataFrame([(0, "y"), (1, "x")], "ord int, doc_id string")
    docs = spark.createDataFrame([("x", "t", "a")], "doc_id string, title string, abstract string")
    assert [tuple(r) for r in parsers.in_request_order(asked, docs).select("ord", "doc_id", "title").orderBy("ord").collect()] == [(0, "y", ""), (1, "x", "t")]
