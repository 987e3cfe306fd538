"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its reply
trainable. If turns follow the last assistant turn, or there is none, one more example without a
target carries the whole conversation, so the examples hold every turn. All of it is column arithmetic.

Template of a turn: ``<|turn|>`` role, line break, text, ``<|end|>``, line break. Inside roles and texts a
backslash is doubled and one is put into every control string, the template's own and the common
``</s>``, ``<s>``, ``[INST]`` and ``[/INST]``; a line break in a role gets one before it. Removing the
backslashes restores the text. ``loss_start`` and ``loss_end`` are code points of the formatted string
around the escaped reply.

Turns are ordered by ``turn``, then role and text, where turns have equal numbers (repeated rows are
turns of their own); a null turn comes first. Null texts and roles are empty, rows without
``conv_id`` form one conversation, and an empty table gives no examples. A conversation is one row of
the result, so its turns are gathered in one place; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.session import string

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
ASSISTANT = "assistant"
# What may not stand unescaped inside a text, cut behind its first character.
_CONTROL = r"(<)(\||/?s>)|(\[)(/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, text: Column) -> Column:
    head = F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))
    return F.concat(F.lit(OPEN), head, F.lit("\n"), escape(text), F.lit(CLOSE))


def examples(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> ``conv_id``, ``example``, ``formatted``, ``loss_start``, ``loss_end``."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), string("role").alias("role"), string("text").alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = F.transform("turns", lambda t: _turn(t["role"], t["text"]))
    whole = whole.select("conv_id", "turns", blocks.alias("blocks"))
    # The example that ends with turn k, for every assistant turn and for the last turn of all.
    ends = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda k: (F.element_at("turns", k)["role"] == ASSISTANT) | (k == F.size("turns")),
    )
    spread = whole.select("conv_id", "turns", "blocks", F.posexplode(ends).alias("example", "k"))
    formatted = spread.select(
        "conv_id",
        F.col("example").cast("bigint").alias("example"),
        F.array_join(F.slice("blocks", 1, F.col("k")), "").alias("formatted"),
        (F.element_at("turns", F.col("k"))["role"] == ASSISTANT).alias("_target"),
        F.char_length(escape(F.element_at("turns", F.col("k"))["text"])).cast("bigint").alias("_reply"),
    )
    end = F.char_length("formatted").cast("bigint") - len(CLOSE)
    return formatted.select(
        "conv_id",
        "example",
        "formatted",
        F.when(F.col("_target"), end - F.col("_reply")).alias("loss_start"),
        F.when(F.col("_target"), end).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of ``role`` and ``text``."""
    parts = F.slice(F.split(formatted, r"\Q<|turn|>\E", -1), 2, 1 << 30)
    body = F.transform(parts, lambda p: F.substring(p, F.lit(1), F.char_length(p) - len(CLOSE)))
    header = r"(?s)^((?:[^\\\n]|\\.)*+)\n(.*)$"
    return F.transform(
        body,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, header, 1)).alias("role"), unescape(F.regexp_extract(p, header, 2)).alias("text")
        ),
    )


def read_target(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example: what lies under its loss mask, unescaped."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def digest(found: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text and sizes.

    Every example of a conversation already lies with the others, so nothing is shuffled again.
    """
    target = F.when(F.col("loss_start").isNotNull(), read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_end")))
    per = found.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.struct("example", target.alias("text")))).alias("targets"),
        F.sum(F.char_length("formatted")).cast("bigint").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("targets", lambda t: t["text"]), "")
    read = per.select("conv_id", read_turns(F.col("longest")).alias("turns"), loss.alias("loss"), "formatted_chars")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
