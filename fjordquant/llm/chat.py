"""Chat formatting with a grammar round trip.

A conversation becomes one string of turns,

    <s>[INST] LEVEL ROLE [/INST] TEXT</s>

LEVEL says how the turn's text is written: 0 as it is, 1 with the characters
that control strings begin with replaced.  The text is first rendered without
any escape, read back by a parser that cuts at the turn boundary only, and
compared with the source; turns that hold control strings are escaped until the
two agree.  The loss mask is the text of the turns whose role is assistant.

Edge cases: null text and null role count as empty; a null conversation id is a
conversation of its own; a null turn comes first; rows that repeat a turn are all
kept, ordered by role and text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, MID = "<s>[INST] ", "</s>", " [/INST] "
BOUNDARY = CLOSE + OPEN
LOSS_ROLE = "assistant"
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")]
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def conflicts(text: Column) -> Column:
    hit = F.lit(False)
    for mark in CONTROL:
        hit = hit | F.contains(text, F.lit(mark))
    return hit


def render(turns: Column, escaped) -> Column:
    """One string from an array of (role, text); ``escaped(turn)`` picks the level."""
    def one(t: Column) -> Column:
        level = escaped(t)
        return F.concat(
            F.lit(OPEN), F.when(level, "1").otherwise("0"), F.lit(" "), escape(t["role"]),
            F.lit(MID), F.when(level, escape(t["text"])).otherwise(t["text"]), F.lit(CLOSE))

    return F.array_join(F.transform(turns, one), "")


def quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation.

    A text ends at the first control string, whichever it is.
    """
    token = "|".join(quoted(mark) for mark in CONTROL)
    inner = F.substring(formatted, len(OPEN) + 1,
                        F.length(formatted) - len(OPEN) - len(CLOSE))
    pieces = F.split(inner, quoted(BOUNDARY), -1)

    def one(piece: Column) -> Column:
        parts = F.split(piece, quoted(MID), 2)
        body = F.get(F.split(F.get(parts, 1), token, 2), 0)
        return F.struct(
            unescape(F.substr(F.get(parts, 0), F.lit(3))).alias("role"),
            F.when(F.startswith(piece, F.lit("1")), unescape(body)).otherwise(body).alias("text"))

    return F.transform(pieces, one)


def format_conversations(df: DataFrame, conversation: str, turn: str, role: str,
                         text: str) -> DataFrame:
    """One row per conversation: ``conversation``, formatted, escape_level, turns.

    ``turns`` is what the parser reads back from ``formatted``.  A conversation is
    one value by definition, so its turns are gathered; nothing else is.
    """
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = (
        df.groupBy(F.col(conversation).alias("_id")).agg(F.array_sort(F.array_agg(row)).alias("_t"))
        .withColumn("_source", F.transform(
            "_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
        .select("_id", "_source")
    )
    tries = [
        render(F.col("_source"), lambda t: F.lit(False)),
        render(F.col("_source"), lambda t: conflicts(t["text"])),
        render(F.col("_source"), lambda t: F.lit(True)),
    ]
    fits = [F.lit(level) for level in range(len(tries))]
    level = F.when(parse(tries[0]) == F.col("_source"), fits[0]).when(
        parse(tries[1]) == F.col("_source"), fits[1]).otherwise(fits[2])
    formatted = F.when(F.col("escape_level") == 0, tries[0]).when(
        F.col("escape_level") == 1, tries[1]).otherwise(tries[2])
    return (
        source.withColumn("escape_level", level).withColumn("formatted", formatted)
        .select(F.col("_id").alias(conversation), "formatted", "escape_level")
        .withColumn("turns", parse(F.col("formatted")))
    )


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == LOSS_ROLE),
                                    lambda t: t["text"]), "")
