import hashlib
import json
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom import tables
from lexiloom.functions import spans
from lexiloom.functions import text as T
from lexiloom.operators import analytics, ordering, plugins, tagging
from lexiloom.operators import dictionaries as dic
from lexiloom.plans import annotate, formats, load
from lexiloom.streaming.files import annotate_stream

TAGS = "doc_id int, etype string, sent_idx int, word_idx int, word string, start int, end int, tag string, p double"
ENTITY = "doc_id long, etype string, start int, end int, score double"


def test_scores_leave_out_a_last_word_of_one_character(spark):
    rows = [(1, "gene", 0, 0, "ab", 0, 2, "B", 0.5), (1, "gene", 0, 1, "c", 4, 5, "I", 0.9), (1, "gene", 1, 0, "x", 9, 10, "B", 0.3)]
    rows += [(1, "gene", 1, 2, "gap", 12, 15, "I", 0.1), (1, "drug", 0, 1, "c", 4, 5, "I", 0.9), (1, "drug", 0, 3, "dd", 6, 8, "B", 0.25), (1, "drug", 0, 4, "ee", 9, 11, "I", 0.75)]
    found = tagging.decode(spark.createDataFrame(rows, TAGS), mentions=True).orderBy("start").collect()
    assert [(r["etype"], r["start"], r["end"], r["score"], r["mention"]) for r in found] == [("gene", 0, 5, 0.5, "ab  c"), ("drug", 6, 11, 0.5, "dd ee"), ("gene", 9, 10, 0.3, "x")]


def test_rivals(spark):
    spans_ = {0: [("disease", 0.9), ("gene", 0.8)], 10: [("disease", 0.7), ("gene", 0.7)], 20: [("disease", 0.5), ("gene", 0.6), ("drug", 0.7), ("species", 0.7)], 30: [("gene", None), ("mutation", 0.1)]}
    rows = [(1, t, s, s + 5, p) for s, all_ in spans_.items() for t, p in all_] + [(1, "gene", 0, 4, 0.1)]
    kept = tagging.resolve(spark.createDataFrame(rows, ENTITY)).collect()
    assert {(r["start"], r["end"], r["etype"]) for r in kept} == {(0, 5, "disease"), (10, 15, "disease"), (10, 15, "gene"), (20, 25, "drug"), (20, 25, "species"), (30, 35, "gene"), (30, 35, "mutation"), (0, 4, "gene")}


def test_everyday_words(spark):
    assert len(tagging.HUMAN_WORDS) == 46 == len(set(tagging.HUMAN_WORDS))
    rows = [("species", "patients"), ("species", "homo sapiens"), ("species", "PATIENTS"), ("gene", "man"), ("species", None)]
    kept = tagging.drop_common_species(spark.createDataFrame(rows, "etype string, mention string")).collect()
    assert [tuple(r) for r in kept] == [rows[1], rows[2], rows[3], rows[4]]


def test_reanchoring(spark):
    contents = spark.createDataFrame([(1, "aaaa b aa"), (2, "\U0001f600ab ab"), (3, "x")], "doc_id int, content string")
    rows = [(1, "aa", 0, 9, 0), (1, "aa", 3, 9, 1), (2, "ab", 5, 9, 1), (2, "ab", 1, 9, 0), (3, "x", 0, 9, 0), (3, "x", 0, 9, 1), (3, "No text", 0, 9, 2)]
    found = spans.reanchor(spark.createDataFrame(rows, "doc_id int, mention string, start int, end int, ordinal int"), contents).collect()
    assert {(r["doc_id"], r["ordinal"]): (r["start"], r["error"]) for r in found} == {
        (1, 0): (0, None), (1, 1): (1, None), (2, 0): (1, None), (2, 1): (4, None), (3, 0): (0, None), (3, 1): (None, "mention not in text"),
    }


def test_occurrences_equal_a_plain_search():
    """Mentions that hold and overlap each other, empty ones, and characters outside the first plane."""
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("aab\U0001f600") for _ in range(rng.randrange(0, 40)))
        mentions = [rng.choice(["a", "aa", "aba", "b", "", "\U0001f600a", "c", "aaaa"]) for _ in range(rng.randrange(0, 12))]
        seen, expected = Counter(), []
        for m in mentions:
            places = [i for i in range(len(text) - len(m) + 1) if text[i : i + len(m)] == m]
            expected.append(places[seen[m]] if seen[m] < len(places) else None)
            seen[m] += 1
        assert spans.occurrences(text, mentions) == expected


def test_many_mentions_of_a_long_text(spark):
    """Ten thousand equal mentions in a text of a million characters: one pass."""
    text = "ab c " * 200_000
    start = time.perf_counter()
    assert spans.occurrences(text, ["b c"] * 10_000 + ["absent"]) == [5 * i + 1 for i in range(10_000)] + [None]
    assert time.perf_counter() - start < 2
    rows = spark.range(10_000).selectExpr("1 as doc_id", "'b c' as mention", "cast(-id as int) as start", "0 as end", "cast(id as int) as ordinal", "id as x")
    found = spans.reanchor(rows, spark.createDataFrame([(1, text), (2, None)], "doc_id int, content string"))
    assert found.columns == ["doc_id", "mention", "ordinal", "x", "start", "end", "error"]
    assert {(r["start"], r["x"]) for r in found.collect()} == {(5 * i + 1, 9_999 - i) for i in range(10_000)}


def test_reanchoring_of_odd_rows(spark):
    """Null mentions go; null and missing contents; no rows."""
    contents = spark.createDataFrame([(1, None), (2, "xx"), (None, "xx")], "doc_id int, content string")
    schema = "doc_id int, mention string, start int, end int, ordinal int"
    rows = [(1, "x", 0, 1, 0), (2, None, 0, 1, 0), (2, "x", None, 1, 1), (2, "x", 0, 1, 2), (3, "x", 0, 1, 0), (None, "x", 0, 1, 0)]
    found = spans.reanchor(spark.createDataFrame(rows, schema), contents).collect()
    assert {(r["doc_id"], r["ordinal"], r["start"], r["error"]) for r in found} == {(1, 0, None, "mention not in text"), (2, 1, 0, None), (2, 2, 1, None)}
    assert spans.reanchor(spark.createDataFrame([], schema), contents).count() == 0


def test_request_texts(spark):
    texts = {None: "no text", "": "empty text", " \t \x1c": "only whitespace letters", "a": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.request_error(F.col("t"))).collect()] == list(texts.values())
    ids = spark.createDataFrame([("pmid=1,2&format=json",), ("format=x&pmid=" + ",".join("123456789ab"),), ("pmid=",), (None,)], "q string")
    n = F.size(T.id_list(F.col("q")))
    assert [r[0] for r in ids.select(T.id_error(F.when(T.id_list(F.col("q")).isNotNull(), n))).collect()] == [None, "Too many (> 10) pmids: 11", "No pmid param", "No pmid param"]
    guard = spark.createDataFrame([("12 é",), ("a",), ("",)], "t string").select(T.guard_letters(F.col("t"))).collect()
    assert [r[0] for r in guard] == ["No ascii letters. Please enter your text in English.", "a", "No ascii letters. Please enter your text in English."]
    row = spark.createDataFrame([("29446767", "a &amp;lt; b &eacute;", None)], "a string, b string, c string").select(T.content_hash(F.col("a")), T.html_unescape("b"), T.html_unescape("c")).first()
    assert tuple(row) == (hashlib.sha224(b"29446767").hexdigest(), "a &lt; b é", None)


def test_cleaning(spark):
    odd = "a\r  b　 "
    assert spark.createDataFrame([(odd,)], "t string").select(T.clean_unicode(F.col("t"))).first()[0] == "a  bΗ°　 "
    assert spark.createDataFrame([("a\r\n\tb   c ",)], "t string").select(T.clean_whitespace(F.col("t"))).first()[0] == "a  b c "
    assert spark.createDataFrame([("x" * 60 + "\r\ny\tz",)], "t string").select(T.clean_request(F.col("t"))).first()[0] == "x" * 50 + " y z"


def names_of(spark, pairs):
    return spark.createDataFrame(pairs, "name string, oid string")


def mentions_of(spark, rows):
    return spark.createDataFrame([(1, "t", i, m) for i, m in enumerate(rows)], "doc_id int, etype string, ordinal int, mention string")


def ids_of(df):
    return [r["ids"] for r in df.orderBy("ordinal").collect()]


def test_normalizers(spark):
    lines = spark.createDataFrame([(0, "10001||Imatinib|STI-571"), (1, "10002||imatinib"), (2, "bad")], "line_no int, value string")
    table = dic.parse_table(spark.createDataFrame([(0, "10002\tM:1,C:2"), (1, "one")], "line_no int, value string"))
    drugs = dic.drug_normalizer(dic.parse_names(lines, T.drug_key(F.col("name"))), table, "P:")
    assert ids_of(drugs(mentions_of(spark, ["IMA tinib", "STI 571", "other", None]))) == [["M:1", "C:2", "P:10002"], ["P:10001"], ["CUI-less"], ["CUI-less"]]
    diseases = dic.disease_normalizer(names_of(spark, [("flu", "a|b"), ("cold", "c")]), spark.createDataFrame([("a", ["M:1"])], "oid string, ext_ids array<string>"), "P:")
    assert ids_of(diseases(mentions_of(spark, ["flu", "cold", "Flu"]))) == [["M:1", "P:a", "P:b"], ["P:c"], ["CUI-less"]]
    species = dic.species_normalizer(names_of(spark, [("Homo sapiens", "960600"), ("mouse", "1009000")]))
    assert ids_of(species(mentions_of(spark, ["Homo sapiens", "Mouse", "HOMO SAPIENS"]))) == [["NCBI:txid9606"], ["NCBI:txid10090"], ["CUI-less"]]
    mutations = dic.mutation_normalizer(names_of(spark, [("p.F83S", "500")]), "P:")
    named = mentions_of(spark, ["x", "y"]).withColumn("normalized_name", F.when(F.col("mention") == "x", "p.F83S;CorrespondingGene:5290").otherwise("p.F83"))
    assert ids_of(mutations(named)) == [["P:500"], ["CUI-less"]]


def test_gene_cascade(spark):
    linker = lambda m: m.withColumn("gid", F.when(F.col("mention") == "A", "7-x").when(F.col("mention") == "E", "8").otherwise("none"))
    table = dic.parse_gene_table(
        spark.createDataFrame([(0, "7\tHGNC:HGNC:5|E:1"), (1, "9\tX:1"), (2, "8\t ")], "line_no int, value string").where("value NOT LIKE '8%'"), names_of(spark, [("7", "70"), ("8", "80")])
    )
    genes = dic.gene_normalizer(
        linker, dic.parse_gene_ids(spark.createDataFrame([(0, "70||7-1|7-2")], "line_no int, value string")), names_of(spark, [("B", "b")]), names_of(spark, [("B", "no"), ("C", "c")]),
        dic.parse_merged(spark.createDataFrame([(0, "c\told"), (1, "c\td")], "line_no int, value string")), table, "P:",
    )
    assert ids_of(genes(mentions_of(spark, ["A", "B gene", "C", "D", "E"]))) == [["HGNC:5", "E:1", "P:70"], ["P:b"], ["P:d"], ["CUI-less"], ["CUI-less"]]


def registry_of(spark, **more):
    drugs = dic.drug_normalizer(names_of(spark, [("longword", "1")]), spark.createDataFrame([], "oid string, ext_ids array<string>"), "P:")

    def pattern(docs):
        return docs.where("contains(content, 'zz')").select("doc_id", F.lit(0).alias("ordinal"), F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("zz").alias("mention"), F.array(F.lit("Z")).alias("ids"))

    return plugins.Registry(annotate.gazetteer_tagger, {"disease": dic.disease_normalizer(names_of(spark, []), spark.createDataFrame([], "oid string, ext_ids array<string>"), "P:"), "gene": drugs}, {"pathway": pattern})


def test_whole_plan(spark):
    """Types by length, mutations at their places, patterns only where the request has an entity, unknown types without ids."""
    texts = [(1, "T", "zz longword here."), (2, "zz", "no one"), (3, "c.1A>G", ""), (4, None, "another nineletter seventh"), (5, "zz", None)]
    docs = spark.createDataFrame(texts, "doc_id long, title string, abstract string")
    found = spark.createDataFrame([(3, 0, 0, "c.1A>G", "SNP", "p.N1"), (3, 1, 0, "gone", "SNP", "p")], "doc_id long, ordinal int, start int, mention string, type string, id string")
    made = {r["doc_id"]: json.loads(r["json"]) for r in annotate.annotate(docs, registry_of(spark), found).collect()}
    one = lambda x: [(d["obj"], d["span"]["begin"], d["span"]["end"], d["id"]) for d in x["denotations"]]
    assert one(made[1]) == [("pathway", 0, 2, ["Z"]), ("gene", 5, 13, ["P:1"])] and made[1]["text"] == "T zz longword here."
    assert one(made[2]) == [] and made[2]["sourcedb"] == "PubMed"
    assert made[3]["denotations"] == [{"id": ["CUI-less"], "span": {"begin": 0, "end": 6}, "obj": "mutation", "mutationType": "SNP", "normalizedName": "p.N1"}]
    assert one(made[4]) == [("disease", 8, 26, ["CUI-less"])] or one(made[4]) == [("drug", 8, 26, ["CUI-less"])]
    assert made[4]["sourcedb"] == "" and one(made[5]) == []
    together = annotate.annotations(docs, registry_of(spark), found, requests=F.lit(1)).where("etype = 'pathway'").select("doc_id").collect()
    assert sorted(r[0] for r in together) == [1, 2, 5]
    always = annotate.annotations(docs, registry_of(spark), found, compat=False).where("etype = 'pathway'").select("doc_id").collect()
    assert sorted(r[0] for r in always) == [1, 2, 5]
    assert annotate.annotate(docs.limit(0), registry_of(spark)).count() == 0


def test_json_forms(spark):
    docs = spark.createDataFrame([(1, 'say "é"\n')], "doc_id long, text string")
    found = spark.createDataFrame([(1, "gene", 1, 3, 9, 0.5, ["a", "b"]), (1, "drug", 0, 3, 5, 0.25, ["c"]), (1, "gene", 0, 0, 2, None, ["d"])], "doc_id long, etype string, ordinal int, start int, end int, score double, ids array<string>")
    times = F.struct(F.lit(1.5).alias("ner"))
    row = formats.annotation_json(docs, found, "p", elapsed=times, stamp=F.timestamp_seconds(F.lit(0)), scores=formats.logits(found), indent=True).first()["json"]
    out = json.loads(row)
    assert [d["id"] for d in out["denotations"]] == [["d"], ["c"], ["a", "b"]] and out["elapsed_time"] == {"ner": 1.5} and out["timestamp"] == "Thu Jan 01 00:00:00 +0000 1970"
    assert out["logits"] == {"drug": [{"span": {"start": 3, "end": 5}, "score": 0.25}], "gene": [{"span": {"start": 3, "end": 9}, "score": 0.5}]}
    assert "\n" in row and list(out) == sorted(out) and out["text"] == 'say "é"\n'
    lines = formats.ner_lines(docs.select("doc_id", F.lit("t").alias("title"), F.lit("a").alias("abstract")), found, "m").first()["value"]
    assert list(json.loads(lines)) == ["abstract", "entities", "ner_model", "pmid", "title"] and json.loads(lines)["entities"]["drug"] == [{"start": 3, "end": 5}]
    errors = spark.createDataFrame([(None, "tool: no response")], "doc_id string, message string")
    assert json.loads(formats.error_texts(errors).first()["written"])["text"] == "error: tool: no response"
    assert formats.error_texts(errors, "pubtator").first()["written"] == "|t|\n|a|error: tool: no response\n\n"


def test_text_form_orders_by_start_then_type(spark):
    docs = spark.createDataFrame([(1, "T", "A")], "doc_id long, title string, abstract string")
    rows = [(1, "species", 0, 5, 6, "m", ["a"]), (1, "mutation", 0, 5, 7, "n", ["b", "c"]), (1, "gene", 0, 0, 1, "o", ["d"])]
    found = spark.createDataFrame(rows, "doc_id long, etype string, ordinal int, start int, end int, mention string, ids array<string>")
    assert formats.annotation_text(docs, found).first()["block"] == "1|t|T\n1|a|A\n1\t0\t1\to\tgene\td\n1\t5\t7\tn\tmutation\tb|c\n1\t5\t6\tm\tspecies\ta\n\n"


@pytest.mark.parametrize("range_rows", [1, 7, 1000])
def test_numbers_over_ranges(spark, range_rows):
    rows = spark.range(100).select((F.col("id") * 37 % 101).alias("place"), (F.col("id") % 9).alias("oid"))
    got = [r["n"] for r in ordering.numbered(rows, ["place"], "n", range_rows).orderBy("place").collect()]
    assert got == list(range(100))
    best = {r["place"]: r["uid"] for r in analytics.best_ids(rows, 3, range_rows).collect()}
    seen, want = set(), {}
    for r in rows.orderBy("place").collect():
        seen.add(r["oid"])
        want[r["place"]] = len(seen) * 100 + 3
    assert best == want and ordering.numbered(rows.limit(0), ["place"], "n").count() == 0


def test_run_statistics(spark):
    runs = spark.createDataFrame([("a", i, float(i)) for i in range(6)], "stage string, event_id int, seconds double")
    found = analytics.log_line_stats(runs, "event_id", 3).orderBy("n").collect()
    assert [(r["n"], r["mean"], r["low"], r["high"]) for r in found] == [(3, 1.0, 0.0, 2.0), (6, 2.5, 0.0, 5.0)]
    drawn = [r[0] for r in analytics.sampled(spark.range(100), 5, 1).collect()]
    assert len(set(drawn)) == 5 and analytics.sampled(spark.range(3), 5, 1).count() == 3


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"longword{i} and anotherword. Next sentence{i}") for i in range(20)], "doc_id long, text string")
    source, sink = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    docs.repartition(3).write.parquet(source)
    plan = lambda df: annotate.entities(annotate.documents(df)).select("doc_id", "etype", "start", "end", "mention")
    annotate_stream(spark, source, "doc_id long, text string", plan, sink, f"file://{tmp_path}/check", files=1).awaitTermination()
    got = spark.read.parquet(sink).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plan(docs).collect())) and got.count() > 20


def test_tables(spark, monkeypatch):
    df = spark.range(5)
    kept = tables.materialise(df, "test")
    path = re.sub(r"/part-.*", "", kept.inputFiles()[0])
    assert kept.count() == 5 and path.startswith("file:")
    tables.discard(kept, df)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.schema("id long").parquet(path).count()
    with tables.temporary("stays"):
        gone, stays = tables.materialise(df, "goes"), tables.materialise(df, "stays")
    assert stays.count() == 5 and tables._paths.get(gone) is None
    assert tables.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(tables, "SMALL_BYTES", 0)
    assert tables.spread(df) is df


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: None)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Cluster)


def test_load_runs(spark):
    docs = spark.createDataFrame([(i, None, f"longword{i} text {i}") for i in range(9)], "doc_id long, title string, abstract string")
    rows = load.runs(docs, registry_of(spark), 5, 1, size=2)
    got = rows.collect()
    assert sorted((r["run"], r["stage"], r["n_documents"]) for r in got) == sorted((b, s, n) for b, n in ((0, 2), (1, 2), (2, 1)) for s in load.STAGES)
    assert all(r["seconds"] > 0 and r["error"] is None for r in got)
    assert {r["stage"] for r in load.summary(rows, 2).collect()} == set(load.STAGES)

    def fails(sents):
        raise RuntimeError("no model")

    bad = load.runs(docs, plugins.Registry(fails), 2, 1).collect()
    assert [(r["stage"], r["error"]) for r in bad] == [(None, "RuntimeError: no model")] * 2
    assert load.runs(docs.limit(0), registry_of(spark), 2, 1).count() == 0
    assert {r["error"]: r["n"] for r in analytics.error_counts(load.runs(docs, plugins.Registry(fails), 3, 1)).collect()} == {"RuntimeError: no model": 3}
