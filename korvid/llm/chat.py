"""Chat formatting with Spark expressions: sort, merge adjacent turns, escape, concatenate.

A block of adjacent turns with one role is written as

    <s>role[INST]text[/INST][INST]text[/INST]</s>

and a conversation is its blocks in order. A control string inside a text or role gets one more
backslash after its first character than it had (</s> becomes <\\/s>, and <\\/s> becomes <\\\\/s>),
so that a reader finds only true marks and takes one backslash off to get the text back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings, without their first character.
CONTROL = ("s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>")
OPENING = ("<", "[")
_REST = "|".join(re.escape(x).replace("/", "/") for x in CONTROL)
ESCAPE = rf"([<\[])(\\*)({_REST})"
UNESCAPE = rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def format_chats(
    turns: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, formatted, mask): one row per conversation.

    mask is the loss mask as runs of code points in the order of formatted, array of
    struct(n int, loss boolean): text of loss_role is under the mask, marks and other roles are
    not. Turns are sorted by turn, then role and text, so ties and repeated rows keep a fixed
    order; null turns come first, null roles and texts count as empty. Rows with a null conv_id
    form one conversation. An empty table gives none; other columns are not read.
    """
    item = F.struct(
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    convs = turns.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("t"))
    # Places where a block starts: the first turn and every change of role.
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"]))
    convs = convs.select("conv_id", "t", starts.alias("s"))
    ends = F.concat(F.slice("s", 2, F.size("s")), F.array(F.size("t") + 1))
    blocks = F.transform(
        F.arrays_zip(F.col("s").alias("a"), ends.alias("b")),
        lambda x: F.struct(F.element_at("t", x["a"])["role"].alias("role"), F.transform(F.slice("t", x["a"], x["b"] - x["a"]), lambda y: escape(y["text"])).alias("texts")),
    )
    convs = convs.select("conv_id", blocks.alias("blocks"))

    def runs(b: Column) -> Column:
        own = b["role"] == loss_role
        head = F.struct((F.length(escape(b["role"])) + 3).alias("n"), F.lit(False).alias("loss"))
        inner = F.flatten(
            F.transform(
                b["texts"],
                lambda x: F.array(
                    F.struct(F.lit(6).alias("n"), F.lit(False).alias("loss")),
                    F.struct(F.length(x).alias("n"), own.alias("loss")),
                    F.struct(F.lit(7).alias("n"), F.lit(False).alias("loss")),
                ),
            )
        )
        return F.concat(F.array(head), inner, F.array(F.struct(F.lit(4).alias("n"), F.lit(False).alias("loss"))))

    written = F.transform(
        "blocks",
        lambda b: F.concat(F.lit("<s>"), escape(b["role"]), F.concat_ws("", F.transform(b["texts"], lambda x: F.concat(F.lit("[INST]"), x, F.lit("[/INST]")))), F.lit("</s>")),
    )
    return convs.select("conv_id", F.array_join(written, "").alias("formatted"), F.flatten(F.transform("blocks", runs)).alias("mask"))


_BLOCK = re.compile(r"<s>(.*?)((?:\[INST\].*?\[/INST\])*)</s>", re.S)
_TURN = re.compile(r"\[INST\](.*?)\[/INST\]", re.S)
_ESCAPED = re.compile(UNESCAPE)


def plain(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    for m in _BLOCK.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        out += [(plain(m[1]), plain(x)) for x in _TURN.findall(m[2])]
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def under_mask(formatted: str, mask) -> str:
    """The text under the loss mask, unescaped run by run."""
    out, at = [], 0
    for n, loss in mask:
        if loss:
            out.append(plain(formatted[at : at + n]))
        at += n
    return "".join(out)
