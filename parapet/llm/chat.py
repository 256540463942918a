r"""Conversations as one training string each, and back, in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are
merged into a block with array functions; blocks and texts are concatenated with their
marks. No Python runs on the executors, and no fold copies its result at every step, so the
work is linear in the length of a conversation.

The template::

    system      <<SYS>>text<</SYS>>
    user        [INST]text[/INST]
    assistant   <s>text</s>
    other role  [ROLE]role[/ROLE]text[END]

Merged turns of a block are joined by ``[NEXT]``. Inside texts and names of roles, a control
string gets one backslash after its first character (``</s>`` becomes ``<\/s>``), and one
that has backslashes there gets one more; reading takes one away. So a control string never
stands in an escaped text, and every text comes back as it was. The loss mask covers the
texts of assistant turns, not their marks.

Defined cases: a null text or role is an empty one; rows of one turn number stand in order
of role, then escaped text; a null turn number comes first; repeated rows are turns of their
own; a row without a conversation id is a conversation of its own; other columns are not
read; an empty table gives no rows. A conversation must fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions.once import bind, computed

#: Fixed marks: the roles with marks of their own, then those of all other roles.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, END_ROLE, END, NEXT = "[ROLE]", "[/ROLE]", "[END]", "[NEXT]"
LEARNED = "assistant"

_ANGLE, _SQUARE = r"(?:/?s>|</?SYS>>)", r"(?:/?INST\]|/?ROLE\]|END\]|NEXT\])"
_PLAIN = rf"<(?=\\*{_ANGLE})|\[(?=\\*{_SQUARE})"
_ESCAPED = rf"(?<=<)\\(?=\\*{_ANGLE})|(?<=\[)\\(?=\\*{_SQUARE})"
_BLOCK = (r"(?s)(<<SYS>>|\[INST\]|<s>|\[ROLE\].*?\[/ROLE\])(.*?)"
          r"(?:<</SYS>>|\[/INST\]|</s>|\[END\])")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "")


def _mark(role: Column, place: int) -> Column:
    """The opening (0) or closing (1) mark of a role."""
    other = F.concat(F.lit(ROLE), role, F.lit(END_ROLE)) if place == 0 else F.lit(END)
    for name, marks in MARKS.items():
        other = F.when(role == name, marks[place]).otherwise(other)
    return other


def collected(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the sorted turns of each conversation, texts and roles escaped."""
    turn = F.struct(
        F.col("turn"), escaped(F.coalesce("role", F.lit(""))).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"))
    rows = conversations.select("conv_id", turn.alias("turn"))
    named = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"))
    return named.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array("turn").alias("turns")))


def merged(turns: Column) -> Column:
    """Adjacent turns of one role as ``role, texts``; ``turns`` must be a plain column."""
    role = lambda i: F.get(turns, i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: ~role(i - 1).eqNullSafe(role(i)))
    return bind(starts, lambda first: F.transform(first, lambda start, k: F.struct(
        role(start).alias("role"),
        F.transform(F.slice(turns, start + 1, F.coalesce(F.get(first, k + 1), F.size(turns)) - start),
                    lambda t: t["text"]).alias("texts"))))


def _segments(block: Column) -> Column:
    """A block as pieces of text with their loss mask."""
    loss = block["role"] == LEARNED
    piece = lambda text, masked: F.struct(text.alias("text"), masked.alias("loss"))
    last = F.size(block["texts"]) - 1
    bodies = F.transform(block["texts"], lambda text, i: F.array(
        piece(F.when(i == 0, _mark(block["role"], 0)).otherwise(NEXT), F.lit(False)),
        piece(text, loss),
        piece(F.when(i == last, _mark(block["role"], 1)).otherwise(""), F.lit(False))))
    return F.flatten(bodies)


def formatted(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments``: the string, and the same string as an array of
    ``text, loss`` in order, where ``loss`` marks what is learned from."""
    sorted_turns = computed(collected(conversations), turns=F.col("turns"))
    blocks = computed(sorted_turns, blocks=merged(F.col("turns")))
    segments = computed(blocks, segments=F.flatten(F.transform("blocks", _segments)))
    return segments.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def turns_of(text: Column) -> Column:
    """The turns of a formatted string as an array of ``role, text``."""
    marks = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(2))
    other = lambda m: unescaped(F.substr(
        m, F.lit(len(ROLE) + 1), F.length(m) - len(ROLE + END_ROLE)))

    def role(mark: Column) -> Column:
        named = other(mark)
        for name, (opening, _) in MARKS.items():
            named = F.when(mark == opening, name).otherwise(named)
        return named

    return F.flatten(F.zip_with(marks, bodies, lambda mark, body: bind(role(mark), lambda name: F.transform(
        F.split(body, r"\[NEXT\]", -1),
        lambda t: F.struct(name.alias("role"), unescaped(t).alias("text"))))))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def read_back(output: DataFrame) -> DataFrame:
    """``conv_id, turns, learned, formatted_chars`` of formatted conversations."""
    return computed(
        output, turns=turns_of(F.col("formatted")), learned=learned_text(F.col("segments")),
        formatted_chars=F.length("formatted").cast("long"),
    ).select("conv_id", "turns", "learned", "formatted_chars")


def digest(read: DataFrame) -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
