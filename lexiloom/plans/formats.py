"""Sinks: annotation JSON, annotation text, auxiliary dictionaries, tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("mutation", "drug", "gene", "disease", "species", "miRNA", "pathway")


def type_rank() -> Column:
    return F.array_position(F.lit(list(ORDER)), F.col("etype"))


def denotations(entities: DataFrame) -> DataFrame:
    """doc_id and denotations, ordered by begin and type, then by the order within a type (ids: array of strings).

    Mutations carry mutation_type and normalized_name where the entities have these columns.
    """
    more = [F.col(c) if c in entities.columns else F.lit(None).cast("string").alias(c) for c in ("mutation_type", "normalized_name")]
    one = F.struct(F.col("start").alias("begin"), F.col("etype").alias("obj"), F.col("ordinal"), F.col("end"), F.col("ids").alias("id"), *more)
    flat = F.transform(
        F.array_sort(F.collect_list(one)),
        lambda x: F.struct(
            x["id"].alias("id"), F.struct(x["begin"].alias("begin"), x["end"].alias("end")).alias("span"), x["obj"].alias("obj"),
            x["mutation_type"].alias("mutationType"), x["normalized_name"].alias("normalizedName"),
        ),
    )
    return entities.groupBy("doc_id").agg(flat.alias("denotations"))


def logits(entities: DataFrame) -> DataFrame:
    """doc_id and logits: by type the spans and scores of a document's tagged entities."""
    one = F.struct(F.struct(F.col("start"), F.col("end")).alias("span"), F.col("score"))
    by_type = entities.where("score IS NOT NULL").groupBy("doc_id", "etype").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    return by_type.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("etype", "spans")))).alias("logits"))


def annotation_json(
    docs: DataFrame, entities: DataFrame, project: str, sourcedb: str = "PubMed", elapsed: Column | None = None, stamp: Column | None = None,
    scores: DataFrame | None = None, indent: bool = False,
) -> DataFrame:
    """doc_id and json of every document (doc_id, text, and sourcedb if it differs by document), with or without entities.

    ``stamp`` adds the time of writing, ``scores`` (doc_id, logits) the tagger's scores, ``elapsed`` a struct of stage times;
    ``indent`` writes the object on several lines with sorted keys.
    """
    none = F.array().cast("array<struct<id:array<string>,span:struct<begin:int,end:int>,obj:string,mutationType:string,normalizedName:string>>")
    rows = docs.join(denotations(entities), "doc_id", "left")
    rows = rows if scores is None else rows.join(scores, "doc_id", "left")
    whole = {
        "project": F.lit(project), "sourcedb": F.col("sourcedb") if "sourcedb" in docs.columns else F.lit(sourcedb), "sourceid": F.col("doc_id").cast("string"),
        "text": F.col("text"), "denotations": F.coalesce("denotations", none),
        "timestamp": None if stamp is None else timestamp_text(stamp), "logits": None if scores is None else F.col("logits"), "elapsed_time": elapsed,
    }
    fields = {k: v for k, v in whole.items() if v is not None}
    shape = F.struct(*[v.alias(k) for k, v in (sorted(fields.items()) if indent else fields.items())])
    return rows.select("doc_id", F.to_json(shape, {"pretty": str(indent).lower()}).alias("json"))


def annotation_text(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id and block: title and abstract lines, then a line an entity by start, type order and ordinal, ids pipe-joined."""
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "mention", "etype", F.array_join("ids", "|"))
    ordered = F.array_sort(F.collect_list(F.struct("start", type_rank().alias("r"), "ordinal", line.alias("line"))))
    lines = entities.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))
    none = F.array().cast("array<string>")
    head = F.array(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("t"), "title"), F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("a"), "abstract"))
    rows = docs.join(lines, "doc_id", "left")
    return rows.select("doc_id", F.concat(F.array_join(F.concat(head, F.coalesce("lines", none)), "\n"), F.lit("\n\n")).alias("block"))


def error_document(doc_id: Column, message: Column) -> Column:
    return F.struct(doc_id.alias("doc_id"), F.lit("").alias("title"), F.concat(F.lit("error: "), message).alias("abstract"))


def error_texts(errors: DataFrame, form: str = "json", project: str = "lexiloom") -> DataFrame:
    """doc_id (empty if it is null) and the written form of requests that failed (doc_id, message): a document whose abstract is the error."""
    row = errors.select(error_document(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("message")).alias("d")).select("d.*")
    none = row.limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("etype", "string"), ("ordinal", "int"), ("start", "int"), ("end", "int"), ("mention", "string"), ("ids", "array<string>"))])
    if form == "json":
        return annotation_json(row.select("doc_id", F.col("abstract").alias("text")), none, project).withColumnRenamed("json", "written")
    return annotation_text(row, none).withColumnRenamed("block", "written")


def ner_lines(docs: DataFrame, entities: DataFrame, model: str) -> DataFrame:
    """value: one JSON object a document (doc_id, title, abstract) with sorted keys: abstract, entities by type, ner_model, pmid, title."""
    one = F.struct("start", "end")
    by_type = entities.groupBy("doc_id", "etype").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    held = by_type.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("etype", "spans")))).alias("entities"))
    whole = F.struct("abstract", "entities", F.lit(model).alias("ner_model"), F.col("doc_id").cast("string").alias("pmid"), "title")
    return docs.join(held, "doc_id", "left").select("doc_id", F.to_json(whole).alias("value"))


def fixed(c: Column | str, digits: int) -> Column:
    """A double with so many digits, as C prints it: its exact value is rounded, ties to even."""

    @F.arrow_udf("string")
    def shown(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.{digits}f}" for x in values.to_pylist()], pa.string())

    return shown(c)


def stats_lines(stats: DataFrame, columns: list[str], missing: str | None = "") -> DataFrame:
    """value: tab-separated lines of the columns, as a benchmark's log has them; ``missing`` stands for nulls (None: such a line is null)."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns]
    line = F.concat_ws("\t", *texts)
    return stats.select((line if missing is not None else F.when(F.forall(F.array(*texts), lambda x: x.isNotNull()), line)).alias("value"))


def auxiliary_lines(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.concat_ws("||", F.col("uid").cast("string"), "mention").alias("value"))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "EEE MMM dd HH:mm:ss Z yyyy")
