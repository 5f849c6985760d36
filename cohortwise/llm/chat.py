"""Chat formatting: turns to one marked text with a loss mask, in Spark expressions only.

A conversation's turns are collected as structs and sorted. Adjacent turns of one role become one
block; the texts of a block are parted by a mark, so that every turn can be read back:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n<|im_start|>..

A text or role can't forge a mark: each "<", backslashes, "|" in it gets one more backslash, which
`unescaped` takes away again. Other text is not changed. Line feeds in a role become a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The marks of the template: fixed values.
START, END, PART, LINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_nl|>"
CLOSE = END + "\n"


def escaped(text: Column) -> Column:
    """`text` without "<|": one more backslash in each run of backslashes between "<" and "|"."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role, from the sorted array `turns`."""
    n = F.size(turns)
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(n))
    return F.zip_with(begins, ends, lambda a, b: F.struct(
        F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: escaped(t["text"])).alias("texts")))


def _block(block: Column) -> Column:
    return F.concat(F.lit(START), _role(block["role"]), F.lit("\n"), F.array_join(block["texts"], PART), F.lit(CLOSE))


def _mask(block: Column, loss_role: str) -> Column:
    """One (before, under, after) per turn: code points outside, under, and again outside the loss."""
    head = F.lit(len(START) + 1) + F.length(_role(block["role"]))
    count = F.size(block["texts"])

    def run(text: Column, i: Column) -> Column:
        before = F.when(i == 0, head).otherwise(F.lit(0))
        after = F.when(i == count - 1, F.lit(len(CLOSE))).otherwise(F.lit(len(PART)))
        under = F.when(block["role"] == loss_role, F.length(text)).otherwise(F.lit(0))
        return F.struct(before.alias("before"), under.alias("under"), (after + F.length(text) - under).alias("after"))

    return F.transform(block["texts"], run)


def formatted(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant",
) -> DataFrame:
    """(conversation, formatted, loss_mask): one row per conversation.

    `loss_mask` has one struct per turn: `before`, `under` and `after` count code points of `formatted`
    outside, under and outside the loss; one turn's follow the turn's before, and their sum is the length of
    `formatted`. Under the loss are the whole (escaped) texts of `loss_role`.

    Turns are ordered by `turn`, nulls first; equal ones by role and text. Repeated rows are turns of
    their own. Null texts and roles are empty. Rows whose conversation is null have nothing to be put together by:
    each is a conversation of one turn. An empty table gives no rows; other columns are ignored.
    """
    said = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.select(F.col(conversation).alias("__conversation"), said.alias("__said"))
    talks = rows.where("__conversation is not null").groupBy("__conversation").agg(F.array_sort(F.collect_list("__said")).alias("__turns"))
    alone = rows.where("__conversation is null").select("__conversation", F.array("__said").alias("__turns"))
    blocks = talks.unionAll(alone).select("__conversation", _merged(F.col("__turns")).alias("__blocks"))
    return blocks.select(
        F.col("__conversation").alias(conversation),
        F.array_join(F.transform("__blocks", _block), "").alias("formatted"),
        F.flatten(F.transform("__blocks", lambda b: _mask(b, loss_role))).alias("loss_mask"))


def pieces(text: Column) -> Column:
    """The parts of a formatted text that belong to one turn each, marks included."""
    return F.filter(F.split(text, r"(?<=<\|im_end\|>\n)|(?<=<\|im_sep\|>)"), lambda p: p != "")


def read(text: Column) -> Column:
    """Turns (role, text) of a formatted text, as they were before."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.instr(block, "\n")
        role = F.replace(block.substr(F.lit(len(START) + 1), at - len(START) - 1), F.lit(LINE), F.lit("\n"))
        texts = F.split(block.substr(at + 1, F.length(block)), r"<\|im_sep\|>")
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_loss(text: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, one per turn (empty for turns without loss)."""
    return F.zip_with(pieces(text), mask, lambda p, m: unescaped(p.substr(m["before"] + 1, m["under"])))
