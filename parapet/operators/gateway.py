"""Threat scoring of incoming questions.

``evaluate`` runs as one narrow projection chain. Composition (of texts that it could
change), entropy, repeated units and the words that a signature cannot do without are looked
at in Python, as Arrow batches; the patterns themselves stay in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from parapet.functions import signatures as S, text as T
from parapet.functions.entropy import char_entropy, level_score
from parapet.functions.once import bind, computed
from parapet.functions.signatures import Rule

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_unicode(df: DataFrame, column: str, out: str) -> DataFrame:
    """NFC, then drop control characters other than newline, tab and carriage return.

    Characters below U+0300 never change under NFC, so a text made of them is passed to
    the Arrow function as null and keeps its value.
    """
    text = F.col(column)
    composed = _compose(F.when(text.rlike(r"[^\x00-\u02ff]"), text))
    return df.withColumn("_composed", composed).withColumn(
        out, F.regexp_replace(F.coalesce(F.col("_composed"), text), CONTROL, "")
    ).drop("_composed")


def validated(text: Column) -> Column:
    """Why a raw question is refused before scoring, or null."""
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(F.contains(text, F.lit("\0")), "null_byte")
    )


MAX_TOP_K = 20  # fixed value: the largest number of hits a request may ask for


def request_problem(text: Column, top_k: Column) -> Column:
    """Bounds of the request form: 1..8192 characters, top_k 1..20; no top_k is out of range."""
    return (
        F.when(text.isNull() | (F.length(text) < 1), "query_too_short")
        .when(F.length(text) > S.MAX_QUERY_CHARS, "query_too_long")
        .when(top_k.isNull() | ~top_k.between(1, MAX_TOP_K), "top_k_out_of_range")
    )


def matched_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """Positions of all rules found in the text, in catalogue order.

    The words of the rules are looked up in one pass; only a text that holds those of a
    rule is searched for its pattern.
    """
    possible = S.possible_rules(text, rules) if any(rule.words for rule in rules) else None

    def found(i: int, rule: Rule) -> Column:
        hit = rule.found_in(text)
        return F.array_contains(possible, F.lit(i)) & hit if rule.words else hit

    return F.array_compact(F.array(*[F.when(found(i, rule), i) for i, rule in enumerate(rules)]))


def until_critical(positions: Column, rules: Sequence[Rule]) -> Column:
    """Cut the list after the first rule of critical severity: later rules do not count."""
    critical = [i for i, rule in enumerate(rules) if rule.severity >= S.CRITICAL_SEVERITY]

    def cut(found: Column) -> Column:
        first = F.array_position(F.transform(found, lambda p: p.isin(critical)), True)
        return F.when(first > 0, F.slice(found, F.lit(1), first.cast("int"))).otherwise(found)

    return bind(positions, cut)


def _lookup(positions: Column, values: Sequence) -> Column:
    table = F.array(*[F.lit(v) for v in values])
    return F.transform(positions, lambda p: F.element_at(table, p + 1))


def score_threats(
    df: DataFrame, column: str, rules: Sequence[Rule] = S.INJECTION_RULES
) -> DataFrame:
    """Add ``rule_hits, entropy, entropy_score, triggered_rules, score, threat_level``.

    A null text is not scored; all added columns are then null.
    """
    text = F.col(column)
    hits = computed(
        df,
        rule_hits=F.when(text.isNotNull(), until_critical(matched_rules(text, rules), rules)),
        entropy=F.when(text.isNotNull(), char_entropy(text)),
    )
    scored = hits.withColumn(
        "entropy_score",
        F.when(F.length(text) < S.ENTROPY_MIN_CHARS, 0)
        .when(text.isNotNull(), level_score(F.col("entropy"))),
    )
    by_rule = _lookup(F.col("rule_hits"), [r.label for r in rules])
    severity = F.coalesce(F.array_max(_lookup(F.col("rule_hits"), [r.severity for r in rules])),
                          F.lit(0))
    scored = scored.withColumn(
        "triggered_rules",
        F.when(F.col("entropy_score") > 0, F.array_append(by_rule, F.lit(S.ENTROPY_RULE)))
        .otherwise(by_rule),
    ).withColumn(
        "score", F.when(text.isNotNull(), F.greatest(severity, F.col("entropy_score")))
    )
    return scored.withColumn("threat_level", threat_level(F.col("score")))


def threat_level(score: Column) -> Column:
    return (
        F.when(score >= S.BLOCK_SCORE, "BLOCKED")
        .when(score >= S.SUSPICIOUS_SCORE, "SUSPICIOUS")
        .when(score.isNotNull(), "CLEAN")
    )


def threat_rank(level: Column) -> Column:
    return F.when(level == "BLOCKED", 2).when(level == "SUSPICIOUS", 1).otherwise(0)


def is_blocked(score: Column, strict: bool = True) -> Column:
    return score >= (S.SUSPICIOUS_SCORE if strict else S.BLOCK_SCORE)


def sanitize(text: Column) -> Column:
    """Remove tags, redact template expressions, shorten runs of blanks, strip."""
    untagged = F.regexp_replace(text, S.TAG, "")
    redacted = F.regexp_replace(untagged, S.TEMPLATE, "[REMOVED]")
    return T.strip(F.regexp_replace(redacted, r"[ \t]{4,}", "   "))


def evaluate(
    df: DataFrame,
    column: str = "text",
    strict: bool = True,
    rules: Sequence[Rule] = S.INJECTION_RULES,
    reject_empty: bool = False,
) -> DataFrame:
    """The whole gateway: one result row per question.

    Adds ``query_hash, reject_reason, threat_level, score, triggered_rules, blocked,
    rejection_reason, sanitized_text``. Questions with a ``reject_reason`` were not valid
    and are not scored; questions over the length limit are blocked before any rule runs.
    """
    raw = F.col(column)
    checked = df.withColumn("reject_reason", validated(raw)).withColumn("_text", T.strip(raw))
    if reject_empty:
        checked = checked.withColumn(
            "reject_reason", F.coalesce("reject_reason", F.when(F.col("_text") == "", "empty"))
        )
    valid = F.col("reject_reason").isNull()
    too_long = valid & (F.length("_text") > S.MAX_QUERY_CHARS)
    gated = checked.select(
        "*",
        F.when(valid, F.sha2("_text", 256)).alias("query_hash"),
        too_long.alias("_too_long"),
        F.when(valid & ~too_long, F.col("_text")).alias("_short"),
    )
    scored = score_threats(normalize_unicode(gated, "_short", "_normal"), "_normal", rules)
    scored = scored.select(
        *df.columns, "query_hash", "reject_reason", "_too_long", "_normal",
        F.when(F.col("_too_long"), "BLOCKED").otherwise(F.col("threat_level")).alias("threat_level"),
        F.when(F.col("_too_long"), 100).otherwise(F.col("score")).cast("long").alias("score"),
        F.when(F.col("_too_long"), F.array(F.lit(S.LENGTH_RULE)))
        .otherwise(F.col("triggered_rules")).alias("triggered_rules"),
    )
    decided = scored.withColumn("blocked", F.col("_too_long") | is_blocked(F.col("score"), strict))
    return decided.select(
        *df.columns, "query_hash", "reject_reason", "threat_level", "score", "triggered_rules",
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        F.when(F.col("_too_long"), S.REASON_LENGTH)
        .when(F.col("blocked"), S.REASON_POLICY).alias("rejection_reason"),
        F.when(~F.col("blocked"), sanitize(F.col("_normal"))).alias("sanitized_text"),
    )


def rejections(evaluated: DataFrame, *ids: str) -> DataFrame:
    """What a blocked caller is told: reason, short hash, level."""
    return evaluated.where("blocked").select(
        *ids,
        F.col("rejection_reason").alias("detail"),
        F.substring("query_hash", 1, 16).alias("query_hash"),
        "threat_level",
    )
