"""Queries over the checks on generated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.functions import signatures as S, text as T
from parapet.operators import metrics, output as O
from parapet.plans import derived as D
from parapet.plans.derived import EDGE_L, EDGE_R, SP, WS_BODY
from parapet.sources.tables import text_table

SHORT_LIMIT = 500


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns, and documents with an ending from the payload list, as answers."""
    turns = text_table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat("text", F.lit(" "), D.payload(F.col("conv_id"))).alias("raw_output"),
    )
    docs = text_table(spark, sf, "documents", "doc_id", "text").select(
        (F.lit(1_000_000_000_000) + F.col("doc_id")).alias("query_id"),
        F.concat(D.payload(F.col("doc_id")), F.lit(" "), "text").alias("raw_output"),
    )
    return turns.unionByName(docs)


def _sized(df: DataFrame, column: str) -> DataFrame:
    return df.select(
        "query_id", F.length(column).cast("long").alias("chars"), F.sha2(column, 256).alias("sha")
    )


def truncate_output(spark: SparkSession, sf: str) -> DataFrame:
    rows = answers(spark, sf).select(
        "query_id", O.truncated(F.col("raw_output"), SHORT_LIMIT).alias("cut")
    )
    return _sized(rows, "cut")


def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = text_table(spark, sf, "pages", "page_id", "html").select(
        F.col("page_id").alias("query_id"), O.strip_tags(F.col("html")).alias("plain")
    )
    return _sized(pages, "plain")


def reflection_flag(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select(
        "query_id", O.reflects(F.col("raw_output")).alias("reflection_detected")
    )


def reflection_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Both policies from one pass over the answers."""
    rows = O.sanitize_output(answers(spark, sf), block_reflection=False)
    return rows.select(
        "query_id", O.answer_status(F.col("reflection_detected")).alias("strict_status"),
        F.col("status").alias("lenient_status"),
        F.col("output_text").isNotNull().alias("lenient_has_text"),
    )


def pii_labels(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select(
        "query_id", T.rendered(O.pii_labels(F.col("raw_output"))).alias("pii_types")
    )


def _sanitized(spark: SparkSession, sf: str) -> DataFrame:
    return O.sanitize_output(answers(spark, sf))


def output_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return _sanitized(spark, sf).groupBy("has_warnings", "status").agg(
        F.count("*").alias("answers")
    )


def sanitize_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return _sanitized(spark, sf).select(
        "query_id", "was_truncated", "reflection_detected", "status",
        T.rendered(F.col("pii_types")).alias("pii_types"), "has_warnings",
        F.sha2("output_text", 256).alias("sha"),
    )


def reflections_total(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.reflections_total(_sanitized(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (truncate_output, strip_html, reflection_flag, reflection_policy, pii_labels,
              output_warnings, sanitize_outputs, reflections_total)
}

_ANSWERS = f"""answers AS (
  SELECT conv_id * 1000 + turn AS query_id,
         text || ' ' || {D.sql_payload('conv_id')} AS raw_output
  FROM conversations WHERE role = 'assistant'
  UNION ALL
  SELECT 1000000000000 + doc_id, {D.sql_payload('doc_id')} || ' ' || text FROM documents
)"""


def sql_truncate(text: str, limit: int) -> str:
    head = f"substr({text}, 1, {limit})"
    last = (
        f"(length({head}) - coalesce(nullif(length(regexp_extract({head}, "
        rf"'[^.!?]*$')), length({head})), length({head}) + 1) - 1)"
    )
    notice = S.TRUNCATION_NOTICE.replace("\n", "")
    return (
        f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE "
        f"CASE WHEN {last} > {limit // 2} THEN substr({head}, 1, {last} + 1) ELSE {head} END "
        f"|| chr(10) || chr(10) || '{notice}' END"
    )


def sql_reflects(text: str) -> str:
    return "(" + " OR ".join(
        f"regexp_matches({text}, '(?i){rule.pattern.replace(chr(92) + 's', SP)}')"
        for rule in S.REFLECTION_RULES
    ) + ")"


# Fixed equivalents without look-around: a rule that starts or ends at a word edge is
# written with the neighbouring character; optional prefixes never decide a match.
_PII_SQL = {
    "ssn": rf"{EDGE_L}\d{{3}}-\d{{2}}-\d{{4}}{EDGE_R}",
    "credit_card": rf"{EDGE_L}(\d[ -]?){{12,15}}\d{EDGE_R}",
    "email": rf"{EDGE_L}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{EDGE_R}",
    "phone_us": rf"{EDGE_L}\d{{3}}\)?[{WS_BODY}.\-]\d{{3}}[{WS_BODY}.\-]\d{{4}}{EDGE_R}",
}


def sql_pii(text: str) -> str:
    tests = ", ".join(
        f"CASE WHEN regexp_matches({text}, '{pattern}') THEN '{label}' END"
        for label, pattern in _PII_SQL.items()
    )
    return f"array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',')"


def sql_sanitized(source: str, limit: int = S.MAX_OUTPUT_CHARS) -> str:
    """CTEs from ``source(query_id, raw_output)`` to ``sanitized``."""
    return f"""shortened AS (
  SELECT query_id, length(raw_output) > {limit} AS was_truncated,
         regexp_replace({sql_truncate('raw_output', limit)}, '<[^>]{{0,500}}>', '', 'g') AS t
  FROM {source}
), flagged AS (
  SELECT *, {sql_reflects('t')} AS reflection_detected FROM shortened
), sanitized AS (
  SELECT query_id, was_truncated, reflection_detected,
    CASE WHEN reflection_detected THEN 'BLOCKED_REFLECTION' ELSE 'OK' END AS status,
    CASE WHEN NOT reflection_detected THEN {sql_pii('t')} END AS pii_types,
    CASE WHEN NOT reflection_detected THEN t END AS output_text
  FROM flagged
)"""


_SANITIZED = f"{_ANSWERS}, {sql_sanitized('answers')}"

ORACLE = {
    "truncate_output": f"""WITH {_ANSWERS}, c AS (
  SELECT query_id, {sql_truncate('raw_output', SHORT_LIMIT)} AS t FROM answers)
SELECT query_id, length(t) AS chars, sha256(t) AS sha FROM c""",
    "strip_html": """WITH c AS (
  SELECT page_id AS query_id, regexp_replace(html, '<[^>]{0,500}>', '', 'g') AS t FROM pages)
SELECT query_id, length(t) AS chars, sha256(t) AS sha FROM c""",
    "reflection_flag": f"""WITH {_ANSWERS}
SELECT query_id, {sql_reflects('raw_output')} AS reflection_detected FROM answers""",
    "reflection_policy": f"""WITH {_SANITIZED}
SELECT query_id, status AS strict_status, 'OK' AS lenient_status, TRUE AS lenient_has_text
FROM sanitized""",
    "pii_labels": f"""WITH {_ANSWERS}
SELECT query_id, {sql_pii('raw_output')} AS pii_types FROM answers""",
    "output_warnings": f"""WITH {_SANITIZED}
SELECT reflection_detected OR coalesce(pii_types, '') <> '' AS has_warnings, status,
       count(*) AS answers FROM sanitized GROUP BY 1, 2""",
    "sanitize_outputs": f"""WITH {_SANITIZED}
SELECT query_id, was_truncated, reflection_detected, status, pii_types,
       reflection_detected OR coalesce(pii_types, '') <> '' AS has_warnings,
       sha256(output_text) AS sha FROM sanitized""",
    "reflections_total": f"""WITH {_SANITIZED}
SELECT count(*) FILTER (WHERE reflection_detected) AS value FROM sanitized""",
}
