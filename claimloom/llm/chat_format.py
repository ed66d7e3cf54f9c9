"""Chat formatting with a grammar round trip; DataFrame functions only.

Grammar of the output, read by a deterministic parser::

    conversation = turn*
    turn         = "<|im_start|>" role "\\n" text "<|im_end|>\\n"

Method. Each conversation is rendered as it is and parsed again; if the recovered turns equal the source, it is done.
Otherwise the turns that do not survive a round trip on their own are escaped, and the conversation is rendered, parsed and
compared again; if it still differs, all its turns are escaped. That form always agrees (the escapes are bijections
whose results hold no mark), and a conversation that did not would raise an error instead of being returned.

Escapes. Texts: ``<``, any number of backslashes, ``|`` gets one backslash more, so an escaped text holds no ``<|``; the
parser takes one backslash out of ``<\\|``, ``<\\\\|`` and so on. Roles: ``%``, line feed and ``<`` become ``%25``, ``%0A``
and ``%3C``. Texts in which the parser would change nothing are left as they are.

The result holds the output as segments (text, loss): their texts end to end are the formatted conversation, and those
under the loss mask are the assistant's texts, without marks. A conversation is one string, so its rows meet in one task.

Defined results: null texts and roles are empty. Rows go by turn, nulls first, then by role and text; repeated rows
are repeated turns. Rows without a conv_id form one conversation without an id. Very long texts are whole. An empty table
gives an empty result. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CLOSE = END + "\n"
LEARNED = "assistant"
_ROLE = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))


def escaped_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def plain_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    for a, b in _ROLE:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def plain_role(role: Column) -> Column:
    for a, b in reversed(_ROLE):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def render(turns: Column) -> Column:
    """The conversation of an array of (role, text), already escaped where that is needed."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t.role, F.lit("\n"), t.text, F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; null where it is not in the grammar."""
    parts = F.split(formatted, r"<\|im_start\|>")

    def turn(part: Column) -> Column:
        body = F.when(part.endswith(CLOSE), part.substr(F.lit(1), F.length(part) - len(CLOSE)))
        line = F.instr(body, "\n")
        read = F.struct(plain_role(body.substr(F.lit(1), line - 1)).alias("role"), plain_text(body.substr(line + 1, F.length(body))).alias("text"))
        return F.when((line > 0) & (F.instr(body, END) == 0), read)

    turns = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)
    return F.when((parts[0] == "") & F.forall(turns, lambda t: t.isNotNull()), turns)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, segments (array of text and loss), turns (array of role and text, as parsed from formatted)."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    talks = talks.select("conv_id", F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("source"))
    raw = lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))
    safe = lambda t: F.struct(escaped_role(t.role).alias("role"), escaped_text(t.text).alias("text"))
    agrees = lambda form, source: F.coalesce(parse(form) == source, F.lit(False))
    one = lambda t: F.array(t)
    survives = lambda t: agrees(render(one(raw(t))), one(raw(t)))
    talks = talks.withColumn("first", agrees(render(F.col("source")), F.col("source")))
    some = F.transform("source", lambda t: F.when(survives(t), raw(t)).otherwise(safe(t)))
    talks = talks.withColumn("sent", F.when(F.col("first"), F.col("source")).otherwise(some))
    again = F.col("first") | agrees(render(F.col("sent")), F.col("source"))
    talks = talks.withColumn("sent", F.when(again, F.col("sent")).otherwise(F.transform("source", safe)))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("sent", lambda t: F.array(
        piece(F.concat(F.lit(START), t.role, F.lit("\n")), F.lit(False)), piece(t.text, t.role == LEARNED), piece(F.lit(CLOSE), F.lit(False)))))
    out = talks.select("conv_id", "source", segments.alias("segments"))
    out = out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))
    out = out.withColumn("turns", parse(F.col("formatted")))
    same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    broken = F.raise_error(F.lit("a conversation does not survive its round trip"))
    return out.select("conv_id", F.when(same, F.col("formatted")).otherwise(broken.cast("string")).alias("formatted"), "segments", "turns")


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the output: numbers and hashes of turns and of the text under the loss mask."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: plain_text(s.text)), "")
    out = formatted.select("conv_id", "formatted", "turns", learned.alias("learned"))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
