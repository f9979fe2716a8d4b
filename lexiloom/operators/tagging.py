"""BIO decoding, span scores, conflict resolution and filters over tagged words.

Results for odd input: untagged and outside words may be left out; entities without a score (null) rank last among rivals; empty
tables give no rows; repeated rows of one word count as words of their own in the order they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Class numbers of a tagger: padding, continuation and marks count as outside.
LABELS = {1: "B", 2: "I", 3: "O"}
RIVALS = ("gene", "drug", "disease", "species")
#: Everyday words for people, which are no species mentions.
HUMAN_WORDS = (
    "person|infant|Child|people|participants|woman|Girls|Man|Peoples|Men|Participant|Patients|humans|Persons|mans|participant|"
    "Infants|Boys|Human|Humans|Women|children|Mans|child|Participants|Girl|Infant|girl|patient|patients|boys|men|infants|man|girls|"
    "Children|Boy|women|persons|human|Woman|peoples|Patient|People|boy|Person"
).split("|")


def label(class_column: str):
    out = F
    for number, tag in LABELS.items():
        out = out.when(F.col(class_column) == number, tag)
    return out.otherwise("O")


def confidence():
    """Largest softmax value of a word's class scores."""
    p = F.transform("log_probs", lambda x: F.exp(x.cast("double") - F.array_max("log_probs").cast("double")))
    return 1 / F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def decode(tags: DataFrame, mentions: bool = False) -> DataFrame:
    """Entities doc_id, etype, sent_idx, start, end, score, first_word, last_word from tagged words (confidence ``p``): runs that
    begin with B.

    Words tagged O may be left out: a run also ends where a word's number is not the next one.  A final word of one character
    does not count in the mean, unless it is the only word.  ``mentions`` adds the run's text, which needs no look at the
    document: between words there are only spaces.  One window and one aggregate, on the same partitioning.
    """
    order = Window.partitionBy("doc_id", "etype", "sent_idx").orderBy("word_idx")
    near = {"before": F.lag("word_idx").over(order), "after": F.lead("word_idx").over(order), "tag_after": F.lead("tag").over(order)}
    run = tags.where("tag <> 'O'").withColumns(near)
    goes_on = (F.col("tag") == "I") & F.coalesce(F.col("before") == F.col("word_idx") - 1, F.lit(False))
    ends = ~((F.col("tag_after") == "I") & F.coalesce(F.col("after") == F.col("word_idx") + 1, F.lit(False))) | F.col("tag_after").isNull()
    run = run.withColumns({"g": F.sum(F.when(goes_on, 0).otherwise(1)).over(order), "counts": ~(ends & goes_on & (F.length("word") == 1))})
    words = [F.array_sort(F.collect_list(F.struct("word_idx", "start", "end", "word"))).alias("words")] * mentions
    runs = run.groupBy("doc_id", "etype", "sent_idx", "g").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(F.col("tag") == "B", "word_idx").alias("head"),
        F.avg(F.when(F.col("counts"), F.col("p"))).alias("score"), F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word"), *words,
    ).where("head")
    spaced = "transform(words, (w, i) -> if(i = 0, w.word, concat(repeat(' ', w.start - words[i - 1].end), w.word)))"
    text = [F.array_join(F.expr(spaced), "").alias("mention")] * mentions
    return runs.select("doc_id", "etype", "sent_idx", "start", "end", "score", "first_word", "last_word", *text)


def _breaks(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return codes[1:] != codes[:-1]


def _runs(t: pa.Table, names: list[str]) -> pa.RecordBatch:
    """The entities of tagged words that stand in order."""
    owner, etype, sentence, number, word, start, end, tag, p = (c.combine_chunks() for c in t.columns)
    at, same = number.to_numpy(), ~(_breaks(owner) | _breaks(etype) | _breaks(sentence))
    goes_on = np.zeros(len(t), bool)
    goes_on[1:] = same & (at[1:] == at[:-1] + 1) & pc.equal(tag, "I").to_numpy(zero_copy_only=False)[1:]
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(t)) - 1
    scored = p.is_valid().to_numpy(zero_copy_only=False)
    short = pc.equal(pc.utf8_length(word), 1).to_numpy(zero_copy_only=False)
    scored[last[short[last] & (last > first)]] = False
    n = np.add.reduceat(scored.astype(np.int64), first)
    total = np.add.reduceat(np.where(scored, p.fill_null(0.0).to_numpy(), 0.0), first)
    head = pc.equal(tag, "B").to_numpy(zero_copy_only=False)[first]
    first, last, n, total = first[head], last[head], n[head], total[head]
    a, b = pa.array(first), pa.array(last)
    score = pa.array(total / np.maximum(n, 1), mask=n == 0)
    out = [owner.take(a), etype.take(a), sentence.take(a), start.take(a), end.take(b), score, number.take(a), number.take(b)]
    if "mention" in names:
        gaps = np.append(0, start.to_numpy()[1:] - end.to_numpy()[:-1])
        texts = word.take(a).to_pylist()
        for i in np.flatnonzero(last > first):
            texts[i] += "".join(" " * gaps[j] + word[j].as_py() for j in range(first[i] + 1, last[i] + 1))
        out.append(pa.array(texts, pa.string()))
    return pa.RecordBatch.from_arrays(out, names)


def decode_runs(tags: DataFrame, mentions: bool = False) -> DataFrame:
    """What ``decode`` gives, without a shuffle, for tagged words whose sentences are whole: the words of a sentence and type follow one
    another within a partition, in order, as maps over sentences give them.

    The last sentence of a batch waits for the next one, so at most a batch and a sentence are held.
    """
    key = tags.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "etype", "sent_idx", "start", "end", "score", "first_word", "last_word", *["mention"] * mentions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            rows = [pa.Table.from_batches([batch])] if batch is not None else []
            if held is None and not rows:
                return
            both = pa.concat_tables([*([held] if held is not None else []), *rows])
            keep = len(both)
            if batch is not None and len(both):
                ends = np.flatnonzero(np.logical_or.reduce([_breaks(both.column(i).combine_chunks()) for i in range(3)]))
                keep = int(ends[-1]) + 1 if len(ends) else 0
            held = both.slice(keep)
            if keep:
                yield _runs(both.slice(0, keep), names)

    columns = "sent_idx int, word_idx int, word string, start int, end int, tag string, p double"
    typed = [F.col(c).cast(t) for c, t in (x.split() for x in columns.split(", "))]
    out = f"doc_id {key}, etype string, sent_idx int, start int, end int, score double, first_word int, last_word int" + ", mention string" * mentions
    return tags.where("tag <> 'O'").select("doc_id", "etype", *typed).mapInArrow(run, out)  # words outside don't go to Python


def resolve(entities: DataFrame) -> DataFrame:
    """Of rival types on exactly one span only those of the highest score stay, ties included."""
    rival = F.col("etype").isin(*RIVALS)
    best = F.rank().over(Window.partitionBy("doc_id", "start", "end", rival).orderBy(F.desc("score")))  # one pass: entities are costly to make
    return entities.where("etype IS NOT NULL").withColumn("__best", best).where((F.col("__best") == 1) | ~rival).drop("__best")


def detokenize(pieces: DataFrame) -> DataFrame:
    """Words from subword pieces (doc_id, sent_idx, word_idx, piece_idx, piece, tag, p): the first piece's tag and score."""
    kept = pieces.where(~F.col("piece").isin("[CLS]", "[SEP]"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_idx", "piece"))), lambda x: F.regexp_replace(x["piece"], "^##", "")), "")
    return kept.groupBy("doc_id", "sent_idx", "word_idx").agg(
        text.alias("word"), F.min_by("tag", "piece_idx").alias("tag"), F.min_by("p", "piece_idx").alias("p")
    )


def drop_common_species(entities: DataFrame, denied: list[str] | tuple[str, ...] = tuple(HUMAN_WORDS)) -> DataFrame:
    """Species mentions (column mention) that are everyday words, case-sensitively, are left out."""
    return entities.where(~((F.col("etype") == "species") & F.coalesce(F.col("mention").isin(list(denied)), F.lit(False))))


def entity_counts(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and n of the tagged types; documents without any have 0."""
    n = entities.where(F.col("etype").isin(*RIVALS, "mutation")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").fillna(0, ["n"])
