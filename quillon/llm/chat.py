"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. A deterministic parser reads the rendered
text back; where the turns it recovers differ from the source, the content that conflicts is escaped, and the result is
read back again. Escaping is reversible: in ``<|``, ``<\\|``, ``<\\\\|`` ... one more backslash goes before the bar; a line end
in a role is written ``<nl|``, guarded in the same way. The parser always unescapes, so plain content that looks escaped
fails the round trip and is escaped too.

Only built-in functions are used. Defined cases: null texts and roles are empty; turns are ordered by turn, then role,
then text, nulls first, repeated rows included; a null conv_id is a conversation of its own; no rows give no
conversations; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def _escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return _escape_text(F.replace(F.regexp_replace(role, r"<(\\*)nl\|", r"<$1\\nl|"), F.lit("\n"), F.lit("<nl|")))


def _unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(_unescape_text(role), F.lit("<nl|"), F.lit("\n")), r"<\\(\\*)nl\|", r"<$1nl|")


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n"))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role,text,first,length>>; first and length span the escaped text.

    Each piece between two start marks is a role up to the first line end, then a text up to the first end mark.
    """
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)
    cut = F.transform(pieces, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), p.alias("piece")))
    cut = F.transform(cut, lambda c: F.struct(
        c["role"].alias("role"),
        F.substring_index(F.substr(c["piece"], F.length(c["role"]) + 2), END, 1).alias("text"),
        F.length(c["piece"]).alias("n"),
    ))
    none = F.array().cast("array<struct<role:string,text:string,first:int,length:int>>")
    turn = lambda at, c: F.struct(
        c["role"].alias("role"), c["text"].alias("text"),
        (at + len(START) + F.length(c["role"]) + 1).alias("first"), F.length(c["text"]).alias("length"),
    )
    placed = F.aggregate(
        cut, F.struct(F.lit(0).alias("at"), none.alias("turns")),
        lambda s, c: F.struct((s["at"] + len(START) + c["n"]).alias("at"), F.concat(s["turns"], F.array(turn(s["at"], c))).alias("turns")),
    )["turns"]
    return F.transform(placed, lambda t: F.struct(
        _unescape_role(t["role"]).alias("role"), _unescape_text(t["text"]).alias("text"), t["first"].alias("first"), t["length"].alias("length"),
    ))


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped (whether the plain rendering failed the round trip) and mask: array<struct<first,length>>,
    the spans of formatted, in code points, that carry loss: the assistant texts, escaped as they stand there."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(_plain(F.array_sort(F.collect_list("t"))).alias("source"))
    plain = convs.withColumn("formatted", _render(F.col("source")))
    # a mark within content is escaped in any case: other readers may know it where this parser looks for none
    marked = F.exists("source", lambda t: F.concat(t["role"], F.lit(" "), t["text"]).rlike(r"<\|im_(?:start|end)\|>"))
    tried = plain.withColumn("escaped", (_plain(parse(F.col("formatted"))) != F.col("source")) | marked)
    guarded = F.transform("source", lambda t: F.struct(_escape_role(t["role"]).alias("role"), _escape_text(t["text"]).alias("text")))
    done = tried.withColumn("formatted", F.when(F.col("escaped"), _render(guarded)).otherwise(F.col("formatted")))
    turns = done.withColumn("turns", parse(F.col("formatted")))
    # whatever the content, the reading must now equal the source
    whole = F.when(_plain(F.col("turns")) == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    learned = F.filter("turns", lambda t: t["role"] == LEARNED)
    mask = F.transform(learned, lambda t: F.struct(t["first"].alias("first"), t["length"].alias("length")))
    return turns.select("conv_id", whole.alias("formatted"), "escaped", mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted and mask alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("mask", lambda m: _unescape_text(F.substr(F.col("formatted"), m["first"] + 1, m["length"]))), "")
    return formatted.withColumn("turns", turns).withColumn("loss", under).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
