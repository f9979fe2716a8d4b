"""Chat formatting: a finite-state machine over roles and a declarative template, all in Spark SQL functions.

Every turn becomes three segments: opening mark, text and closing mark.  The template gives each role its marks and
says whether its text is under the loss; marks never are.  Control strings, as the template's marks hold them, are
escaped inside texts by a backslash behind their first character (and look-alikes with backslashes by one more), so
``parse`` restores every text exactly, and so does ``unescape`` for each segment under the loss.  The machine walks
over the roles in turn order and tells at which turn the order breaks.

Results for odd input: a null text is empty; a null or unknown role is written as the template's other role with
its name escaped; equal turns are ordered by role and text; an order that the machine does not accept is still
formatted and marked ``valid`` = false, ``bad_turn`` its first bad position; each row without a
conv_id is a conversation of its own; empty tables give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import table


@dataclass(frozen=True)
class Template:
    #: role: (opening mark, closing mark, text under the loss)
    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<s>[SYS] ", " [/SYS]</s>", False),
            "user": ("<s>[INST] ", " [/INST]</s>", False),
            "assistant": ("<s>[OUT] ", " [/OUT]</s>", True),
        }
    )
    #: for any other role, whose name goes in front of the text, closed by name_end
    other: tuple[str, str, bool] = ("<s>[ROLE] ", " [/ROLE]</s>", False)
    name_end: str = "[TEXT] "
    #: state: {role: next state}; "start" is the first one and any state but "system" may be the last
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )


    @cached_property
    def controls(self) -> list[str]:
        """The control strings of all marks, each in angle or square brackets; between them a mark has only spaces."""
        marks = [m for v in (*self.roles.values(), self.other) for m in v[:2]] + [self.name_end]
        found = [re.findall(r"<[^<>\[\]]*>|\[[^<>\[\]]*\]", m) for m in marks]
        if any("".join(x) != m.replace(" ", "") for x, m in zip(found, marks, strict=True)):
            raise ValueError("marks consist of control strings in brackets and spaces")
        if len({x[0] for x in found[:-1:2]}) != 1:
            raise ValueError("all opening marks begin with one control string")
        return sorted({c for x in found for c in x})

    @property
    def start(self) -> str:
        """What every turn begins with."""
        return self.other[0][: self.other[0].index(">") + 1] if self.other[0][0] == "<" else self.other[0][: self.other[0].index("]") + 1]

    def pattern(self, slashes: str) -> str:
        """A regex of control strings with backslashes behind their first character; three groups."""
        tails = "|".join(sorted({re.escape(c[1:]) for c in self.controls}))
        return rf"([<\[]){slashes}({tails})"


BRACKETS = Template()


def escape(text: Column, t: Template = BRACKETS) -> Column:
    """One more backslash in every control string and in whatever looks like an escaped one."""
    return F.regexp_replace(text, t.pattern(r"(\\*)"), r"$1\\$2$3")


def unescape(text: Column, t: Template = BRACKETS) -> Column:
    return F.regexp_replace(text, t.pattern(r"\\(\\*)"), "$1$2$3")


def _pick(role: Column, values: dict, other) -> Column:
    out = None
    for name, value in values.items():
        out = (F if out is None else out).when(role == name, F.lit(value))
    return out.otherwise(F.lit(other))


def escaped(df: DataFrame, t: Template = BRACKETS) -> DataFrame:
    """conv_id, turn, role and the escaped text of every turn; a map over rows."""
    return df.select("conv_id", "turn", "role", escape(F.coalesce("text", F.lit("")), t).alias("text"))


def segments(role: Column, text: Column, t: Template = BRACKETS) -> Column:
    """The three segments (text, loss) of a turn with its escaped text."""
    name = F.when(role.isin(list(t.roles)), F.lit("")).otherwise(F.concat(escape(F.coalesce(role, F.lit("")), t), F.lit(t.name_end)))
    opening, closing, loss = (_pick(role, {k: v[i] for k, v in t.roles.items()}, t.other[i]) for i in range(3))
    one = lambda x, flag: F.struct(x.alias("text"), flag.alias("loss"))
    return F.array(one(F.concat(opening, name), F.lit(False)), one(text, F.coalesce(loss, F.lit(False))), one(closing, F.lit(False)))


def states(roles: Column, t: Template = BRACKETS) -> Column:
    """Walk the machine over an array of roles: struct(state, n, bad), bad: first position without a move."""
    moves = F.create_map(
        *[F.lit(x) for state, to in t.machine.items() for role, new in to.items() for x in (f"{state} {role}", new)]
    )
    return F.aggregate(
        roles,
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")),
        lambda a, r: F.struct(
            F.coalesce(F.try_element_at(moves, F.concat_ws(" ", a["state"], F.coalesce(r, F.lit("?")))), F.lit("error")).alias("state"),
            (a["n"] + 1).alias("n"),
            F.coalesce(
                a["bad"],
                F.when(F.try_element_at(moves, F.concat_ws(" ", a["state"], F.coalesce(r, F.lit("?")))).isNull(), a["n"]),
            ).alias("bad"),
        ),
    )


def format_conversations(df: DataFrame, t: Template = BRACKETS) -> DataFrame:
    """conv_id, segments (text, loss) in turn order, formatted, valid and bad_turn.

    Escaping runs before the shuffle, where it is spread over all tasks; the group only puts segments in order.  Rows without a
    conv_id are not shuffled.
    """
    rows, turn = escaped(df, t), F.struct("turn", "role", "text")
    turns = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = turns.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns")))
    made = turns.withColumn("walk", states(F.col("turns.role"), t)).withColumn(
        "segments", F.flatten(F.transform("turns", lambda x: segments(x["role"], x["text"], t)))
    )
    return made.select(
        "conv_id",
        "segments",
        F.array_join("segments.text", "").alias("formatted"),
        (F.col("walk.bad").isNull() & ~F.col("walk.state").isin("system", "start")).alias("valid"),
        F.col("walk.bad").alias("bad_turn"),
    )


def under_loss(segs: Column, t: Template = BRACKETS) -> Column:
    """All text under the loss, unescaped, segment by segment with nothing between."""
    return F.array_join(F.transform(F.filter(segs, lambda x: x["loss"]), lambda x: unescape(x["text"], t)), "")


def parse(formatted: Column, t: Template = BRACKETS) -> Column:
    """array<struct<role, text>> read back from the formatted string alone."""
    parts = F.filter(F.split(formatted, re.escape(t.start)), lambda x: x != "")
    marks = {k: v for k, v in t.roles.items()}
    begin = lambda mark: mark.removeprefix(t.start)

    def turn(x: Column) -> Column:
        role = text = None
        for name, (opening, closing, _) in marks.items():
            body = F.substring(x, F.lit(len(begin(opening)) + 1), F.length(x) - len(begin(opening)) - len(closing))
            hit = x.startswith(begin(opening))
            role = (F if role is None else role).when(hit, F.lit(name))
            text = (F if text is None else text).when(hit, body)
        body = F.substring(x, F.lit(len(begin(t.other[0])) + 1), F.length(x) - len(begin(t.other[0])) - len(t.other[1]))
        name = F.substring_index(body, t.name_end, 1)
        rest = F.substring(body, F.length(name) + len(t.name_end) + 1, F.length(body))
        return F.struct(
            role.otherwise(unescape(name, t)).alias("role"),
            unescape(text.otherwise(rest), t).alias("text"),
        )

    return F.transform(parts, turn)


def with_extra(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts are control strings themselves."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_conversations(with_extra(table(spark, sf_dir, "conversations")))
    read = made.withColumn("turns", parse(F.col("formatted")))
    lossy = under_loss(F.col("segments"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.withColumn("lossy", lossy).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("lossy").cast("long").alias("loss_chars"),
        F.sha2("lossy", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )


QUERIES = {"op6_chat_formatting": op6_chat_formatting}


def _sql(t: Template = BRACKETS) -> str:
    added = " ".join(f"WHEN '{k}' THEN {len(v[0]) + len(v[1])}" for k, v in t.roles.items())
    pattern = t.pattern(r"\\*")
    cuts = lambda c: f"len(regexp_extract_all({c}, '{pattern}'))"
    other = len(t.other[0]) + len(t.other[1]) + len(t.name_end)
    moves = ", ".join(f"('{s}', '{r}')" for s, to in t.machine.items() for r in to)
    return f"""
WITH a AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(role) OVER w, 'start') AS was,
    length(text) + {cuts('text')} + CASE role {added} ELSE {other} + length(coalesce(role, '')) + {cuts("coalesce(role, '')")} END AS chars
    FROM a WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn, role, text)),
c AS (SELECT *, (was, role) NOT IN ({moves}) AS bad FROM b)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::bigint AS formatted_chars,
    NOT bool_or(bad) AND arg_max(role, n) <> 'system' AS valid, (min(n) FILTER (bad))::int AS bad_turn
FROM c GROUP BY conv_id, own"""


ORACLES = {"op6_chat_formatting": _sql()}
