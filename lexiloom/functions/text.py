"""Text cleaning and validation as column expressions; all of them stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that are cleaned to a space, and two that stand for other characters.
TO_SPACE = "\u2028\u2029\u200a\u2009\u2008\u2005\u2004\u2003\u2002\u00a0\uf8ff\u202f\ufeff\uf044\uf02d\uf0bb"
TO_OTHER = {"\uf048": "Η", "\uf0b0": "°"}
#: What stands for a text without letters, and what is said of bad requests.
NO_LETTER_TEXT = "No ascii letters. Please enter your text in English."
NO_PARAM, NO_TEXT, EMPTY_TEXT, ONLY_SPACE = "no param", "no text", "empty text", "only whitespace letters"
NO_IDS, TOO_MANY_IDS, MOST_IDS = "No pmid param", "Too many (> {}) pmids: ", 10
WORD_CUT = 50


def clean_unicode(c: Column) -> Column:
    """CR before a space goes; odd spaces become U+0020; two private-use signs become what they show."""
    return F.translate(F.replace(c, F.lit("\r "), F.lit(" ")), TO_SPACE + "".join(TO_OTHER), " " * len(TO_SPACE) + "".join(TO_OTHER.values()))


def clean_whitespace(c: Column) -> Column:
    """CR goes; LF, TAB and U+2029 become spaces; space, U+2028, space becomes one space."""
    flat = F.translate(c, "\n\t\r", "  ")
    return F.translate(F.replace(flat, F.lit(" \u2028 "), F.lit(" ")), "\u2029", " ")


def clean_request(c: Column) -> Column:
    """Line ends and tabs become spaces, and every space-delimited word is cut to WORD_CUT characters."""
    flat = c
    for end in ("\r\n", "\n", "\t"):  # translate looks each character up
        flat = F.replace(flat, F.lit(end), F.lit(" "))
    return F.regexp_replace(flat, f"(?<![^ ])([^ ]{{{WORD_CUT}}})[^ ]+", "$1")


def guard_letters(c: Column) -> Column:
    """A text without any ASCII letter is replaced by a fixed sentence, which the taggers can take."""
    return F.when(~c.rlike("[A-Za-z]"), F.lit(NO_LETTER_TEXT)).otherwise(c)


def content(title: Column, abstract: Column) -> Column:
    """What offsets refer to: the abstract of raw text, the title alone, or both with one space."""
    return F.when(title.isNull(), abstract).when(abstract == "", title).otherwise(F.concat_ws(" ", title, abstract))


def shown_content(title: Column, abstract: Column) -> Column:
    """As ``content``, but an empty title leaves no leading space; offsets are not shifted for it."""
    return F.when(F.coalesce(title, F.lit("")) == "", abstract).otherwise(content(title, abstract))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 224)


def request_error(text: Column, param: Column | None = None) -> Column:
    """What is wrong with a raw request, whose parameter may be missing altogether; null if nothing is."""
    blank = text.rlike(r"^[\s\x1c-\x1f\x85\p{IsWhite_Space}]*$")
    found = F.when(text.isNull(), NO_TEXT).when(text == "", EMPTY_TEXT).when(blank, ONLY_SPACE)
    return found if param is None else F.when(param.isNull(), NO_PARAM).otherwise(found)


def id_error(n_ids: Column, most: int = MOST_IDS) -> Column:
    """What is wrong with a request for so many ids; null if nothing is."""
    return F.when(F.coalesce(n_ids, F.lit(0)) == 0, NO_IDS).when(n_ids > most, F.concat(F.lit(TOO_MANY_IDS.format(most)), n_ids.cast("string")))


def id_list(query: Column, name: str = "pmid") -> Column:
    """The comma-separated ids of one parameter of an address's query (``pmid=1,2&format=json``); null if it is not there."""
    parts = F.transform(F.split(query, "&"), lambda x: F.split(x, "=", 2))
    mine = F.filter(parts, lambda x: (F.size(x) == 2) & (x[0] == name) & (x[1] != ""))
    return F.when(F.size(mine) > 0, F.split(F.url_decode(F.try_element_at(mine, F.lit(1))[1]), ","))


def output_format(asked: Column, known: tuple[str, ...] = ("json", "pubtator")) -> Column:
    """The format that is written: the one asked for if it is known, else the first."""
    return F.when(asked.isin(*known), asked).otherwise(known[0])


def drug_key(name: Column) -> Column:
    """Lower case, without spaces and ASCII punctuation."""
    return F.translate(F.lower(name), " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")


def gene_key(mention: Column) -> Column:
    """Without a trailing " gene", unless that is all."""
    long = (F.length(mention) > 5) & (F.lower(F.right(mention, F.lit(5))) == " gene")
    return F.when(long, F.left(mention, F.length(mention) - 5)).otherwise(mention)


def mutation_key(name: Column) -> Column:
    return F.substring_index(name, ";", 1)


def is_int(c: Column) -> Column:
    return c.try_cast("bigint").isNotNull()


def is_float(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """Character references resolved; Spark has no built-in for it."""
    import html

    return texts.map(html.unescape, na_action="ignore")
