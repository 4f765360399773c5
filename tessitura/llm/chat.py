"""Chat formatting with a grammar round trip.

Grammar of formatted text: ``conversation := turn*``,
``turn := "<s>[INST] " role " [/INST]" text "</s>"``, where role and text hold none of the
control strings ``<s> </s> [INST] [/INST]``. The parser is deterministic: it parts the text at
``</s>`` and reads one turn from each piece, or finds that it is none.

Escaping sets a backslash after the first character of a control string, and one more where
backslashes stand there already; unescaping takes one away. Everything else stays as it is.
The turns of a part are rendered as they are, parsed again and compared (round 0). Where the result
differs from the source, each turn is parsed by itself, and those that differ are escaped (round
1). Where the part still differs, all of its turns are escaped (round 2); a part that differed even
then would raise an error.

All of it is built-in column functions. A conversation is formatted in parts of up to
``PART_TURNS`` turn numbers, so that one of any length is spread over tasks; parts in order,
without anything between them, are the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import at, bound_to, require

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, MID, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
PART_TURNS = 256

_PLACES = r"(<(?=\\{n}/?s>)|\[(?=\\{n}/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLACES.replace("{n}", "*"), r"$1\\")


def unescape(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, _PLACES.replace("{n}", "+") + r"\\", "$1")).otherwise(text)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MID), text, F.lit(CLOSE))


def _clean(text: Column) -> Column:
    """Whether a text holds no control string."""
    return ~((text.contains("<") & (text.contains("<s>") | text.contains("</s>"))) | (text.contains("[") & (text.contains("[INST]") | text.contains("[/INST]"))))


def _turn(piece: Column) -> Column:
    """Role and text of what stands before a close, or null where it is not a turn."""

    def read(sides: Column) -> Column:
        ok = (F.size(sides) == 2) & sides[0].startswith(OPEN)
        made = bound_to(F.struct(F.substring(sides[0], len(OPEN) + 1, 2**31 - 1).alias("role"), F.get(sides, F.lit(1)).alias("text")), lambda t: F.when(_clean(t["role"]) & _clean(t["text"]), F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))
        return F.when(ok, made)

    return bound_to(F.split(piece, r" \[/INST\]", 2), read)


def parse(formatted: Column) -> Column:
    """Turns of formatted text, an array of (role, text); null where it is not in the grammar."""

    def read(pieces: Column) -> Column:
        turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _turn)
        return F.when(F.element_at(pieces, -1) == "", bound_to(turns, lambda t: F.when(F.forall(t, lambda x: x.isNotNull()), t)))

    return bound_to(F.split(formatted, CLOSE, -1), read)


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Formats conversations; returns the id, ``part`` (in order, null first), ``n_turns``,
    ``rounds`` (0: nothing escaped, 1: some turns, 2: all), ``formatted`` and ``loss_spans``.

    ``loss_spans`` has ``start`` and ``length`` in code points of ``formatted``, and ``byte`` and
    ``bytes`` in its UTF-8, for the text of each turn of ``loss_role``. Turns stand by turn number, then role, then text; null numbers
    come first, repeated rows stand beside each other. A null role or text counts as empty; null
    ids are one conversation. Other columns take no part. An empty table gives an empty table.
    """
    require(conversations, id_col, turn_col, role_col, text_col)
    turns = conversations.select(at(conversations, id_col).alias("id"), at(conversations, turn_col).alias("turn"), F.coalesce(at(conversations, role_col), F.lit("")).alias("role"), F.coalesce(at(conversations, text_col), F.lit("")).alias("text"))
    parts = turns.groupBy("id", F.floor(F.col("turn") / PART_TURNS).alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = parts.withColumn("given", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).drop("turns")

    def whole(column: str) -> Column:
        return F.array_join(F.transform(column, lambda t: render(t["role"], t["text"])), "")

    def escaped(t: Column) -> Column:
        return F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))

    def differs(t: Column) -> Column:
        return ~parse(render(t["role"], t["text"])).eqNullSafe(F.array(t))

    parts = parts.withColumn("formatted", whole("given"))
    parts = parts.withColumn("same", parse(F.col("formatted")).eqNullSafe(F.col("given"))).withColumn("rounds", F.when(F.col("same"), 0).otherwise(1))
    parts = parts.withColumn("drawn", F.when(F.col("same"), F.col("given")).otherwise(F.transform("given", lambda t: F.when(differs(t), escaped(t)).otherwise(t))))
    parts = parts.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(whole("drawn")))
    parts = parts.withColumn("same", F.col("same") | parse(F.col("formatted")).eqNullSafe(F.col("given"))).withColumn("rounds", F.when(F.col("same"), F.col("rounds")).otherwise(2))
    parts = parts.withColumn("drawn", F.when(F.col("same"), F.col("drawn")).otherwise(F.transform("given", escaped)))
    parts = parts.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(whole("drawn")))
    right = F.when(F.col("same"), True).otherwise(parse(F.col("formatted")).eqNullSafe(F.col("given")))
    parts = parts.withColumn("formatted", F.when(right, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))))
    parts = parts.withColumn("marks", F.zip_with("given", "drawn", lambda g, d: F.struct((g["role"] == loss_role).alias("loss"), F.length(d["role"]).alias("role"), F.length(d["text"]).alias("text"), F.octet_length(d["role"]).alias("role_bytes"), F.octet_length(d["text"]).alias("text_bytes"))))
    nothing = F.array().cast("array<struct<start:int,length:int,byte:int,bytes:int>>")
    before, after = len(OPEN) + len(MID), len(OPEN) + len(MID) + len(CLOSE)
    spans = F.aggregate(
        "marks",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("byte"), nothing.alias("spans")),
        lambda s, t: F.struct(
            (s["end"] + t["role"] + t["text"] + after).alias("end"),
            (s["byte"] + t["role_bytes"] + t["text_bytes"] + after).alias("byte"),
            F.when(t["loss"], F.array_append(s["spans"], F.struct((s["end"] + t["role"] + before).alias("start"), t["text"].alias("length"), (s["byte"] + t["role_bytes"] + before).alias("byte"), t["text_bytes"].alias("bytes")))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return parts.select(F.col("id").alias(id_col), "part", F.size("given").cast("long").alias("n_turns"), "rounds", "formatted", spans.alias("loss_spans"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What formatted parts hold, a row for each conversation: turns parsed from the text, and
    the unescaped text under the loss mask, as counts and digests.

    A conversation is one record of this digest, so its parts meet in one row. The null id is one conversation;
    a conversation without loss turns has an empty loss text, and an empty table gives an empty table. Other
    columns take no part."""
    require(formatted, id_col, "part", "formatted", "loss_spans")
    data = F.col("formatted").cast("binary")
    parts = formatted.select(F.col(id_col), "part", parse(F.col("formatted")).alias("parsed"), F.transform("loss_spans", lambda s: unescape(F.substring(data, s["byte"] + 1, s["bytes"]).cast("string"))).alias("masked"), F.length("formatted").alias("chars"))
    parts = parts.select(
        F.col(id_col),
        "part",
        F.size("parsed").alias("n"),
        F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("masked", "").alias("loss"),
        "chars",
    )
    whole = parts.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("part", "turns", "loss"))).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    turns, loss = (F.array_join(F.col("parts")[name], "") for name in ("turns", "loss"))
    return whole.select(id_col, "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
