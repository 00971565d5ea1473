r"""Render moderation exchanges as one training text each, and read them back.

An exchange is what is said about a post: rows of ``post_id``, ``turn``, ``role``, ``content`` (system, user and
assistant messages, such as the prompt and the answer of the language-model stage).

Grammar of a rendered exchange, ``text = turn*``::

    turn    = "<s>[INST] " role " [/INST]" content "</s>"
    control = ("<" | "[") mark,  mark one of: s>  /s>  INST]  /INST]
    escaped = ("<" | "[") "\" "\"* mark

The reader splits at ``</s>``, takes the role up to the first `` [/INST]`` and removes one backslash from every
escaped control.  Writing adds one backslash to every control, escaped or not, so reading undoes it exactly.

Edge cases: a null role or content is the empty string; rows of the same turn are ordered by role, then as rendered;
null turns come first; repeated rows are turns of their own; the exchange of a null ``post_id`` is one exchange;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, BETWEEN, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
MARKS = r"/?s>|/?INST\]"
CONTROL = rf"([<\[])(\\*)({MARKS})"
ESCAPED = rf"([<\[])\\(\\*)({MARKS})"
TURN = r"(?s)^<s>\[INST\] (.*?) \[/INST\](.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BETWEEN), content, F.lit(CLOSE))


def parse(text: Column) -> Column:
    """Turns of a rendered text as structs ``role``, ``content``, and both as they stand there, ``raw_role``, ``raw``.

    A piece the grammar does not know has a null role, which equals no source turn.  What follows the last turn
    is a piece as well unless it is empty.
    """
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        known = piece.rlike(TURN)
        raw_role, raw = F.regexp_extract(piece, TURN, 1), F.regexp_extract(piece, TURN, 2)
        return F.struct(
            F.when(known, unescape(raw_role)).alias("role"), F.when(known, unescape(raw)).alias("content"),
            F.when(known, raw_role).alias("raw_role"), F.when(known, raw).alias("raw"))

    return F.transform(pieces, turn)


def reads_back(rendered: Column, role: Column, content: Column) -> Column:
    """Whether a rendered turn reads back as exactly its source."""
    turns = parse(rendered)
    return (F.size(turns) == 1) & F.coalesce((F.get(turns, 0)["role"] == role) & (F.get(turns, 0)["content"] == content), F.lit(False))


def render_turns(messages: DataFrame) -> DataFrame:
    """``post_id``, ``turn``, ``role``, ``content``, ``rendered``: every message rendered so that it reads back.

    Round trip per message: written as it is, read, compared; what differs is escaped, its role and its content, and
    written again.  One round of escaping is enough, see the grammar.
    """
    source = messages.select(
        F.col("post_id").alias("post_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    role, content = F.col("role"), F.col("content")
    # without an opening bracket there is nothing to conflict with, and nothing to parse
    plain = ~(F.contains(role, F.lit("<")) | F.contains(role, F.lit("[")) | F.contains(content, F.lit("<")) | F.contains(content, F.lit("[")))
    first = render_turn(role, content)
    return source.withColumn("rendered", F.when(plain | reads_back(first, role, content), first).otherwise(
        render_turn(escape(role), escape(content))))


def _digest(role: Column, content: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, content), 256))


def render_exchanges(messages: DataFrame) -> DataFrame:
    """One row per ``post_id``: ``formatted`` (the rendered text), ``turns`` (read back), ``loss_spans``, ``identical``.

    ``loss_spans`` are ``start`` and ``length`` in code points of every assistant content, as it stands in ``formatted``;
    ``identical`` is whether the whole text reads back as the source turns.  An exchange is one training text, so
    its messages meet in one row; messages are rendered and escaped before that, one by one.
    """
    turns = render_turns(messages)
    # the source itself stays behind: a digest of each message is enough to compare
    one = F.struct("turn", "role", "rendered", _digest(F.col("role"), F.col("content")).alias("digest"))
    grouped = turns.groupBy("post_id").agg(F.sort_array(F.collect_list(one)).alias("source"))
    formatted = grouped.withColumn("formatted", F.array_join(F.transform("source", lambda t: t["rendered"]), ""))
    read = formatted.withColumn("turns", parse(F.col("formatted")))
    said = F.transform("source", lambda t: t["digest"])
    heard = F.transform("turns", lambda t: _digest(t["role"], t["content"]))
    spans = F.aggregate(
        F.col("turns"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + len(OPEN) + len(BETWEEN) + len(CLOSE) + F.length(t["raw_role"]) + F.length(t["raw"])).cast("long").alias("at"),
            F.when(t["role"] == "assistant", F.array_append(s["spans"], F.struct(
                (s["at"] + len(OPEN) + len(BETWEEN) + F.length(t["raw_role"])).cast("long").alias("start"),
                F.length(t["raw"]).cast("long").alias("length")))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    return read.select("post_id", "formatted", "turns", spans.alias("loss_spans"), F.coalesce(said == heard, F.lit(False)).alias("identical"))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, cut from ``formatted``, unescaped and joined without anything between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest_turns(turns: Column) -> Column:
    """SHA-256 of role, line feed, content, line feed of every turn."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), ""), 256)
