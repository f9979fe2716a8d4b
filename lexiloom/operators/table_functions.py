"""Pattern taggers as table functions of SQL.

``register`` makes ``tag_<type>``, to be called for each text or for a whole table:

    SELECT d.doc_id, t.* FROM docs d, LATERAL tag_mirna(d.content) t
    SELECT * FROM tag_mirna(TABLE(docs) PARTITION BY doc_id)

The first form shuffles nothing.  The second reads the columns doc_id and content; its rows carry doc_id.

Results for odd input: null and empty texts have no mentions; repeated rows repeat them; a table without one of the two columns, or
an argument that is no string, is an error when the query is analysed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexiloom.operators import patterns

#: text -> start, end and mention of each hit, from left to right
Finder = Callable[[str], Iterator[tuple[int, int, str]]]

FOUND = [StructField("ordinal", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("mention", StringType())]


def function(make: Callable[[], Finder]) -> type:
    """A table function of what ``make`` gives; ``make`` runs once a task."""

    class Tag:
        def __init__(self) -> None:
            self.find = make()

        @staticmethod
        def analyze(content: AnalyzeArgument) -> AnalyzeResult:
            if not content.isTable:
                if not isinstance(content.dataType, StringType):
                    raise ValueError("a tagger takes a string or a table with the columns doc_id and content")
                return AnalyzeResult(StructType(FOUND))
            columns = {f.name: f for f in content.dataType.fields}
            if not {"doc_id", "content"} <= columns.keys():
                raise ValueError("a tagged table has the columns doc_id and content")
            return AnalyzeResult(StructType([StructField("doc_id", columns["doc_id"].dataType), *FOUND]))

        def eval(self, content) -> Iterator[tuple]:
            row = not (content is None or isinstance(content, str))
            text, own = (content["content"], (content["doc_id"],)) if row else (content, ())
            for i, hit in enumerate(self.find(text) if text else ()):
                yield (*own, i, *hit)

    return udtf(Tag)


def mirna(prefixes: tuple[str, ...] = patterns.PREFIXES, suffixes: tuple[str, ...] = patterns.SUFFIXES) -> Callable[[], Finder]:
    def make() -> Finder:
        pattern, longest = patterns.mirna_pattern(prefixes, suffixes), max(map(len, prefixes))
        last = re.compile(f"[{re.escape(''.join(sorted({p[-1] for p in prefixes})))}][0-9]", re.IGNORECASE)
        return lambda text: ((m.start(), m.end(), m[0]) for m in patterns.mirna_spans(text, pattern, last, longest))

    return make


def names(dictionary: DataFrame) -> Callable[[], Finder]:
    """Of a dictionary (name, dict_order) that one automaton holds; larger ones are searched by ``patterns.tag_names``."""
    size = dictionary.selectExpr("sum(length(name))").first()[0] or 0
    if size > patterns.BLOCK_CHARS:
        raise ValueError(f"a table function's names have {patterns.BLOCK_CHARS} characters at most, these have {size}")
    order: dict[str, float] = {}
    for row in dictionary.where("name <> ''").select("name", "dict_order").collect():  # bounded above
        order[row["name"]] = min(order.get(row["name"], math.inf), row["dict_order"])

    def make() -> Finder:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name, place in order.items():
            automaton.add_word(name, (place, len(name)))
        automaton.make_automaton()

        def find(text: str) -> Iterator[tuple[int, int, str]]:
            hits = [(e + 1 - n, place, e + 1) for e, (place, n) in automaton.iter(text)] if order else []
            return ((a, b, text[a:b]) for a, _, b in patterns.chosen(hits))

        return find

    return make


def register(spark: SparkSession, etype: str, make: Callable[[], Finder]) -> str:
    """Register the tagger of a type for SQL; its name."""
    name = f"tag_{etype.lower()}"
    spark.udtf.register(name, function(make))
    return name
