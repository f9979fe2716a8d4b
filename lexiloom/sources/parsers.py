"""Sources: annotation exchange text, XML, JSON lines, dictionaries, listings.  Errors are rows, never exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.ordering import RANGE_ROWS, numbered
from lexiloom.sources import split_files

ALLOWED = ("ProteinMutation", "DNAMutation", "SNP")
NO_TEXT = ("- No text -", "-NoAbstract-")
BIOC_SCHEMA = """id string, passage array<struct<infon: array<struct<_key: string, _VALUE: string>>, offset: int, text: string,
    annotation: array<struct<infon: array<struct<_key: string, _VALUE: string>>,
    location: array<struct<_offset: int, _length: int>>, text: string>>>>"""


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (ascending within a file) and value of the lines that are not empty; many tasks read a file (see ``split_files``)."""
    return split_files.file_lines(spark, path).select("line_no", "value")


def blocks(whole: DataFrame) -> DataFrame:
    """One row for each block that a blank line ends (column value: whole texts); what follows the last one is no block."""
    parts = F.split(F.regexp_replace("value", r"[ \t\r]+\n", "\n"), "\n\n+")
    return whole.select(F.posexplode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("block", "value")).where("value <> ''")


def pubtator(blocks_: DataFrame, allowed: tuple[str, ...] | None = None, raw: bool = False, check_ids: bool = False) -> DataFrame:
    """doc_id, title, abstract, annotations (start, end exclusive, mention, type, id), error from blocks of lines.

    A raw block has its text in the title line if it has no abstract line.
    """
    cleaned = F.split(F.regexp_replace("value", "^\n+", ""), "\n")
    rows = blocks_.withColumn("lines", cleaned)
    t, a = (F.split(F.try_element_at("lines", F.lit(i)), rf"\|{x}\|", 2) for i, x in ((1, "t"), (2, "a")))
    rest = F.slice("lines", 3, 1_000_000)
    cols = F.transform(F.filter(rest, lambda x: x != ""), lambda x: F.split(x, "\t"))
    empty = lambda c: F.when(c.isin(*NO_TEXT), "").otherwise(c)
    one = lambda c: F.struct(
        F.try_element_at(c, F.lit(2)).try_cast("int").alias("start"), F.try_element_at(c, F.lit(3)).try_cast("int").alias("end"),
        F.try_element_at(c, F.lit(4)).alias("mention"), F.try_element_at(c, F.lit(5)).alias("type"), F.try_element_at(c, F.lit(6)).alias("id"),
    )
    kept = cols if allowed is None else F.filter(cols, lambda c: F.try_element_at(c, F.lit(5)).isin(*allowed))
    error = (
        F.when(F.size(t) != 2, "bad title line").when(F.size(a) != 2, "bad abstract line")
        .when(F.exists(cols, lambda c: F.size(c) != 6), "bad annotation line")
        .when(F.lit(check_ids) & (F.try_element_at(t, F.lit(1)) != F.try_element_at(a, F.lit(1))), "ids differ")
    )
    title, abstract = empty(F.try_element_at(t, F.lit(2))), empty(F.try_element_at(a, F.lit(2)))
    if raw:
        title, abstract = F.lit(None).cast("string"), F.when(F.coalesce(abstract, F.lit("")) == "", title).otherwise(abstract)
    out = rows.select(
        F.try_element_at(t, F.lit(1)).alias("doc_id"), title.alias("title"), abstract.alias("abstract"),
        F.transform(kept, one).alias("annotations"), error.alias("error"),
    )
    return out.withColumn("annotations", F.when(F.col("error").isNull(), F.col("annotations")))


def annotation_rows(docs: DataFrame) -> DataFrame:
    """One row an annotation, in order of its reported start: doc_id, ordinal, start, end, mention, type, id."""
    return docs.select("doc_id", F.posexplode(F.array_sort("annotations")).alias("ordinal", "x")).select("doc_id", "ordinal", "x.*")


def annotation_objects(docs: DataFrame) -> DataFrame:
    """doc_id, text (title, space, abstract) and denotations (obj, ids split at pipes, span)."""
    one = lambda x: F.struct(
        x["type"].alias("obj"), F.split(x["id"], r"\|").alias("id"), F.struct(x["start"].alias("begin"), x["end"].alias("end")).alias("span")
    )
    return docs.select("doc_id", F.concat_ws(" ", "title", "abstract").alias("text"), F.transform("annotations", one).alias("denotations"))


def bioc(spark: SparkSession, path: str) -> DataFrame:
    """BioC documents of XML files; ids stay text."""
    return spark.read.format("xml").option("rowTag", "document").schema(BIOC_SCHEMA).load(path)


def bioc_texts(responses: DataFrame) -> DataFrame:
    """BioC documents of whole responses (column value), character references resolved first; where that breaks the XML, the
    response is read as it came.  Responses that cannot be read either way give no documents.
    """
    schema = f"document array<struct<{BIOC_SCHEMA.replace('id string', 'id: string', 1).replace('passage array', 'passage: array', 1)}>>, broken string"
    options = {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}
    both = responses.withColumn("plain", T.html_unescape("value"))
    read = both.select(F.from_xml("plain", schema, options).alias("a"), F.from_xml("value", schema, options).alias("b"))
    good = F.when(F.col("a.broken").isNull() & F.col("a.document").isNotNull(), F.col("a.document")).otherwise(F.col("b.document"))
    return read.select(F.explode(good).alias("d")).select("d.*")


def bioc_documents(raw: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, title, abstract, annotations of BioC rows; the last text of a passage type wins."""
    kind = lambda p: F.get(F.filter(p["infon"], lambda i: i["_key"] == "type"), F.lit(0))["_VALUE"]
    passages = F.coalesce("passage", F.array().cast(raw.schema["passage"].dataType))
    last = lambda name: F.coalesce(F.try_element_at(F.filter(passages, lambda p: kind(p) == name), F.lit(-1))["text"], F.lit(""))
    notes = F.flatten(F.transform(passages, lambda p: F.coalesce(p["annotation"], F.array())))
    kept = F.filter(notes, lambda n: kind(n).isin(*allowed))
    place = lambda n: F.get(n["location"], F.lit(0))
    one = lambda n: F.struct(
        place(n)["_offset"].alias("start"), (place(n)["_offset"] + place(n)["_length"]).alias("end"),
        n["text"].alias("mention"), kind(n).alias("type"), F.get(n["infon"], F.lit(0))["_VALUE"].alias("id"),
    )
    return raw.select(F.col("id").alias("doc_id"), last("title").alias("title"), last("abstract").alias("abstract"), F.transform(kept, one).alias("annotations"))


def in_request_order(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """requests (ord, doc_id) with their documents; ids that nothing came for give empty documents."""
    return requests.join(docs, "doc_id", "left").fillna("", ["title", "abstract"])


def pubmed(xml: DataFrame) -> DataFrame:
    """doc_id, title, abstract (null: none) from rows of PubMed article or book XML (column xml)."""
    path = lambda *p: F.coalesce(*[F.when(F.xpath_boolean("xml", F.lit(x)), F.xpath_string("xml", F.lit(x))) for x in p])
    parts = F.xpath("xml", F.lit("//AbstractText//text()"))
    return xml.select(
        path("//PMID").alias("doc_id"), path("//ArticleTitle", "//BookTitle").alias("title"),
        F.when(F.size(parts) > 0, F.array_join(parts, " ")).alias("abstract"),
    )


def pmc(xml: DataFrame) -> DataFrame:
    """doc_id, title, abstract and body text from rows of full-text XML (column xml)."""
    joined = lambda p: F.array_join(F.xpath("xml", F.lit(p)), " ")
    return xml.select(
        F.xpath_string("xml", F.lit("//article-id[@pub-id-type='pmc']")).alias("doc_id"), joined("//article-title[1]//text()").alias("title"),
        joined("//abstract//p//text()").alias("abstract"), joined("//body//p//text()").alias("body"),
    )


JSON_DOCUMENT = "pmid string, title string, abstract string"


def json_documents(lines: DataFrame) -> DataFrame:
    """doc_id, title and abstract, both cleaned, of lines (column value) of one JSON object each; unreadable lines give nulls."""
    x = lines.select(F.from_json("value", JSON_DOCUMENT).alias("x")).select("x.*")
    return x.select(F.col("pmid").alias("doc_id"), T.clean_unicode(F.col("title")).alias("title"), T.clean_unicode(F.col("abstract")).alias("abstract"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    return json_documents(spark.read.text(path))


def tool_json(rows: DataFrame) -> DataFrame:
    """doc_id and mutation spans from annotation JSON (column value)."""
    kind = "sourceid string, text string, denotations array<struct<obj: string, span: struct<begin: int, end: int>>>"
    x = rows.select(F.from_json("value", kind).alias("x")).select("x.*")
    one = lambda d: F.struct(F.replace(d["obj"], F.lit("Mutation:"), F.lit("")).alias("obj"), d["span"]["begin"].alias("start"), d["span"]["end"].alias("end"))
    return x.select(F.col("sourceid").alias("doc_id"), "text", F.transform("denotations", one).alias("spans"))


def file_list(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """Archive members still to fetch: lines of at least five columns whose file is not there yet."""
    cut = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(cut) >= 5).select(F.element_at(cut, 1).alias("file")).join(existing, "file", "left_anti")


def vocabulary(lines: DataFrame) -> DataFrame:
    """token and id (its line); of equal tokens the last line counts."""
    return lines.groupBy(F.col("value").alias("token")).agg(F.max("line_no").alias("id"))


def batches(rows: DataFrame, order: str, size: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Number requests in batches of ``size``."""
    return numbered(rows, [order], "batch", range_rows).withColumn("batch", F.floor(F.col("batch") / size).cast("int"))
