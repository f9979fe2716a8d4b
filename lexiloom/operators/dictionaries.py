"""Dictionary scans and lookups.  Lookups are left outer joins on a normalised key; AQE broadcasts small dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T

UNKNOWN = "CUI-less"


def parse_names(lines: DataFrame, key: Column | None = None, first_wins: bool = False) -> DataFrame:
    """oid and name from lines (line_no, value) of the form oid||name|name; of equal names the last (or first) line wins."""
    cut = F.split("value", r"\|\|", 2)
    names = lines.select("line_no", F.try_element_at(cut, F.lit(1)).alias("oid"), F.posexplode(F.split(F.try_element_at(cut, F.lit(2)), r"\|")).alias("pos", "name"))
    at = F.struct("line_no", "pos")
    pick = F.min_by if first_wins else F.max_by
    return names.withColumn("name", F.col("name") if key is None else key).groupBy("name").agg(pick("oid", at).alias("oid"))


def parse_table(lines: DataFrame, separator: str = ",") -> DataFrame:
    """oid and ext_ids from tab-separated lines; lines of one column are skipped, the last line of an oid wins."""
    cut = F.split("value", "\t")
    rows = lines.where(F.size(cut) >= 2).select("line_no", F.element_at(cut, 1).alias("oid"), F.split(F.element_at(cut, 2), separator).alias("ext_ids"))
    return rows.groupBy("oid").agg(F.max_by("ext_ids", "line_no").alias("ext_ids"))


def parse_pathways(lines: DataFrame) -> DataFrame:
    """name (always with the word pathway), oid, kegg and order; the first line of a name wins."""
    cut = F.split("value", "\t")
    name = F.element_at(cut, 2)
    full = F.when(name.contains("pathway"), name).otherwise(F.concat(name, F.lit(" pathway")))
    rows = lines.where(F.size(cut) >= 2).select("line_no", F.element_at(cut, 1).alias("oid"), full.alias("name"), F.try_element_at(cut, F.lit(3)).alias("kegg"))
    return rows.groupBy("name").agg(F.min_by("oid", "line_no").alias("oid"), F.min_by("kegg", "line_no").alias("kegg"), F.min("line_no").alias("dict_order"))


def parse_mirna(lines: DataFrame) -> DataFrame:
    """name, code (the number and what follows), oid, ext_id and dict_order of lines id, names joined by pipes, accession; lines
    of under three columns and names without a number are skipped, the last line of a name gives its id.
    """
    cut = F.split("value", "\t")
    rows = lines.where(F.size(cut) >= 3).select("line_no", cut[0].alias("oid"), F.posexplode(F.split(cut[1], r"\|")).alias("pos", "name"), cut[2].alias("accession"))
    rows = rows.withColumn("code", F.regexp_extract("name", "[0-9]+.*", 0)).where("code <> ''")
    at = F.struct("line_no", "pos")
    ext = F.when(F.col("accession") != "", F.concat(F.lit("miRBase:"), "accession"))
    return rows.groupBy("name", "code").agg(F.max_by("oid", at).alias("oid"), F.max_by(ext, at).alias("ext_id"), F.min(at).alias("dict_order"))


def parse_gene_ids(lines: DataFrame) -> DataFrame:
    """name (a gene id, cut at its first hyphen) and oid of lines oid||id|id; the last line of an id wins."""
    return parse_names(lines, F.substring_index("name", "-", 1))


def parse_merged(lines: DataFrame) -> DataFrame:
    """name and oid, which takes its place, of tab-separated lines; the last line of a name wins."""
    cut = F.split("value", "\t")
    rows = lines.where(F.size(cut) >= 2).select("line_no", cut[0].alias("name"), cut[1].alias("oid"))
    return rows.groupBy("name").agg(F.max_by("oid", "line_no").alias("oid"))


def parse_gene_table(lines: DataFrame, known: DataFrame) -> DataFrame:
    """oid (a gene id of ``known``) and ext_ids of tab-separated lines; a doubled registry prefix is mended, blank ids are skipped."""
    cut = F.split("value", "\t")
    ids = F.split(F.replace(F.element_at(cut, 2), F.lit("HGNC:HGNC:"), F.lit("HGNC:")), r"\|")
    rows = lines.where((F.size(cut) >= 2) & (F.try_element_at(cut, F.lit(2)) != "")).select("line_no", cut[0].alias("oid"), ids.alias("ext_ids"))
    return rows.join(known.select(F.col("name").alias("oid")), "oid", "left_semi").groupBy("oid").agg(F.max_by("ext_ids", "line_no").alias("ext_ids"))


def duplicates(dictionary: DataFrame) -> DataFrame:
    """Names that stand for several ids; a sound auxiliary dictionary has none."""
    return dictionary.groupBy("name").agg(F.countDistinct("oid").alias("n")).where("n > 1")


def lookup(mentions: DataFrame, dictionary: DataFrame, key: Column) -> DataFrame:
    """Add oid by one exact key; UNKNOWN where there is none.  dictionary: name, oid (unique names)."""
    found = mentions.withColumn("__key", key).join(dictionary.select(F.col("name").alias("__key"), F.col("oid").alias("__oid")), "__key", "left")
    return found.withColumn("oid", F.coalesce("__oid", F.lit(UNKNOWN))).drop("__key", "__oid")


def lookup_cascade(mentions: DataFrame, steps: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Add oid by the first step (dictionary, key) that knows the mention."""
    out = mentions
    for i, (dictionary, key) in enumerate(steps):
        out = out.withColumn(f"__k{i}", key).join(dictionary.select(F.col("name").alias(f"__k{i}"), F.col("oid").alias(f"__o{i}")), f"__k{i}", "left")
    n = range(len(steps))
    found = out.withColumn("oid", F.coalesce(*[F.col(f"__o{i}") for i in n], F.lit(UNKNOWN)))
    return found.drop(*[f"__k{i}" for i in n], *[f"__o{i}" for i in n])


def lookup_drug(m: DataFrame, d: DataFrame) -> DataFrame:
    """d must have been parsed with the key T.drug_key."""
    return lookup(m, d, T.drug_key(F.col("mention")))


def lookup_mutation(m: DataFrame, d: DataFrame) -> DataFrame:
    return lookup(m, d, T.mutation_key(F.col("normalized_name")))


def lookup_species(m: DataFrame, d: DataFrame) -> DataFrame:
    """Exact, else lower case; the id is the taxon."""
    out = lookup_cascade(m, [(d, F.col("mention")), (d, F.lower("mention"))])
    taxon = F.concat(F.lit("NCBI:txid"), F.expr("cast(try_cast(oid AS bigint) div 100 AS string)"))
    return out.withColumn("oid", F.when(F.col("oid") == UNKNOWN, UNKNOWN).otherwise(taxon))


def lookup_gene(m: DataFrame, by_gid: DataFrame, best: DataFrame, frequent: DataFrame, merged: DataFrame) -> DataFrame:
    """gid (cut at its first hyphen), else the two mention dictionaries; then merged ids; all are (name, oid)."""
    key = T.gene_key(F.col("mention"))
    out = lookup_cascade(m, [(by_gid, F.substring_index("gid", "-", 1)), (best, key), (frequent, key)])
    to = merged.select(F.col("name").alias("oid"), F.col("oid").alias("__to"))
    return out.join(to, "oid", "left").withColumn("oid", F.coalesce("__to", "oid")).drop("__to")


def full_ids(m: DataFrame, ext: DataFrame, prefix: str, asked: str = "oid") -> DataFrame:
    """Column ids: of each oid in a pipe-joined oid list the external ids first, all of them, then the prefixed own ids.

    External ids are looked up by the column ``asked``, as for genes, whose own ids are not what the table has.  A mention
    whose only id is UNKNOWN and has no external ids keeps UNKNOWN.  The table is met once for each distinct list, so repeated
    mentions have the same ids each; a null oid gives null ids.
    """
    lists = m.select(F.col(asked).alias("__asked")).where(F.col("__asked").isNotNull()).distinct()
    one = lists.select("__asked", F.posexplode(F.split("__asked", r"\|")).alias("pos", "one"))
    known = one.join(ext.select(F.col("oid").alias("one"), "ext_ids"), "one")
    gathered = known.groupBy("__asked").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ext_ids"))), lambda x: x["ext_ids"])).alias("__ext"))
    own = F.transform(F.split("oid", r"\|"), lambda x: F.when(x == UNKNOWN, UNKNOWN).otherwise(F.concat(F.lit(prefix), x)))
    both = m.withColumn("__asked", F.col(asked)).join(gathered, "__asked", "left")
    return both.withColumn("ids", F.concat(F.coalesce("__ext", F.array().cast("array<string>")), own)).drop("__asked", "__ext")


def named_ids(names: DataFrame, ext: DataFrame, prefix: str) -> DataFrame:
    """The dictionary (name, oid) with ids as ``full_ids`` gives them, so that mentions need one join only."""
    return full_ids(names.select("name", "oid"), ext, prefix).select("name", "oid", "ids")


def lookup_ids(m: DataFrame, named: DataFrame, key: Column) -> DataFrame:
    """Add oid and ids by one exact key; named: name, oid, ids."""
    found = m.withColumn("__key", key).join(named.select(F.col("name").alias("__key"), "oid", "ids"), "__key", "left")
    return found.withColumns({"oid": F.coalesce("oid", F.lit(UNKNOWN)), "ids": F.coalesce("ids", F.array(F.lit(UNKNOWN)))}).drop("__key")


def own_ids(m: DataFrame, prefix: str) -> DataFrame:
    """Column ids: the prefixed own id, or UNKNOWN."""
    return m.withColumn("ids", F.array(F.when(F.col("oid") == UNKNOWN, UNKNOWN).otherwise(F.concat(F.lit(prefix), "oid"))))


def drug_normalizer(names: DataFrame, table: DataFrame, prefix: str):
    """names: parsed with the key T.drug_key; table: oid, ext_ids."""
    return lambda m: lookup_ids(m, named_ids(names, table, prefix), T.drug_key(F.col("mention")))


def disease_normalizer(names: DataFrame, table: DataFrame, prefix: str):
    """names: name and oid, which may be several joined by pipes; exact names stand for a linker of its own."""
    return lambda m: lookup_ids(m, named_ids(names, table, prefix), F.col("mention"))


def mutation_normalizer(names: DataFrame, prefix: str):
    return lambda m: own_ids(lookup_mutation(m, names), prefix)


def species_normalizer(names: DataFrame):
    return lambda m: own_ids(lookup_species(m, names), "")


def gene_normalizer(linker, by_gid: DataFrame, best: DataFrame, frequent: DataFrame, merged: DataFrame, table: DataFrame, prefix: str):
    """linker: adds gid to mentions, as a gene linker of its own does; table: oid (a gid), ext_ids, which come first."""

    def run(m: DataFrame) -> DataFrame:
        found = own_ids(lookup_gene(linker(m), by_gid, best, frequent, merged), prefix)
        ext = table.select(F.col("oid").alias("__gid"), F.col("ext_ids").alias("__ext"))
        both = found.withColumn("__gid", F.substring_index("gid", "-", 1)).join(ext, "__gid", "left")
        return both.withColumn("ids", F.concat(F.coalesce("__ext", F.array().cast("array<string>")), "ids")).drop("__gid", "__ext")

    return run
