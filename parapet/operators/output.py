"""Checks on generated answers: length, markup, echoed injections, personal data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions import signatures as S
from parapet.functions.signatures import Rule


def truncated(text: Column, limit: int = S.MAX_OUTPUT_CHARS) -> Column:
    """Cut to the limit, then back to the last sentence mark if it lies in the second half."""
    head = F.substring(text, 1, limit)
    backwards = F.reverse(head)

    def last(mark: str) -> Column:
        found = F.instr(backwards, F.lit(mark))
        return F.when(found == 0, -1).otherwise(F.length(head) - found)

    end = F.greatest(last("."), last("!"), last("?"))
    cut = F.when(end > limit // 2, F.substring(head, F.lit(1), end + 1)).otherwise(head)
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(S.TRUNCATION_NOTICE))).otherwise(text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, S.TAG, "")


def reflects(text: Column, rules: Sequence[Rule] = S.REFLECTION_RULES) -> Column:
    return reduce(lambda a, b: a | b, [rule.found_in(text) for rule in rules])


def pii_labels(text: Column, rules: Sequence[Rule] = S.PII_RULES) -> Column:
    return F.array_compact(F.array(*[F.when(r.found_in(text), r.label) for r in rules]))


def answer_status(reflected: Column, block_reflection: bool = True) -> Column:
    """What becomes of an answer, with reflections blocked or let through."""
    blocked = reflected if block_reflection else F.lit(False)
    return F.when(blocked, "BLOCKED_REFLECTION").otherwise("OK")


def sanitize_output(
    df: DataFrame,
    column: str = "raw_output",
    limit: int = S.MAX_OUTPUT_CHARS,
    strip_html: bool = True,
    block_reflection: bool = True,
    reflection_rules: Sequence[Rule] = S.REFLECTION_RULES,
    pii_rules: Sequence[Rule] = S.PII_RULES,
) -> DataFrame:
    """Add ``output_text, was_truncated, reflection_detected, pii_types, has_warnings, status``.

    A blocked answer keeps its row with a null text and no personal-data check, so that a
    later report can count it.
    """
    raw = F.col(column)
    step = df.withColumn("was_truncated", F.length(raw) > limit)
    step = step.withColumn("_text", truncated(raw, limit))
    if strip_html:
        step = step.withColumn("_text", strip_tags(F.col("_text")))
    step = step.withColumn("reflection_detected", reflects(F.col("_text"), reflection_rules))
    step = step.withColumn(
        "status", answer_status(F.col("reflection_detected"), block_reflection)
    ).withColumn("output_text", F.when(F.col("status") == "OK", F.col("_text")))
    step = step.withColumn(
        "pii_types", F.when(F.col("status") == "OK", pii_labels(F.col("output_text"), pii_rules))
    )
    return step.withColumn(
        "has_warnings",
        F.col("reflection_detected") | (F.coalesce(F.size("pii_types"), F.lit(0)) > 0),
    ).drop("_text")
