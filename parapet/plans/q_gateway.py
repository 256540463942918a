"""Queries over threat scoring. They share one set of questions, see ``derived``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parapet.functions import signatures as S, text as T
from parapet.functions.entropy import char_entropy, level_score
from parapet.operators import gateway as G, metrics
from parapet.plans import derived as D
from parapet.plans.derived import EDGE_L, EDGE_R, SP, sql_strip
from parapet.sources.tables import text_table

ENTROPY_PLACES = 6


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Questions normalised as the gateway does; one over the length limit keeps its row,
    and the length rule decides for it before any other rule runs."""
    rows = D.questions(spark, sf).select("query_id", T.strip(F.col("text")).alias("text"))
    too_long = F.length("text") > S.MAX_QUERY_CHARS
    gated = rows.select("query_id", too_long.alias("too_long"), F.when(~too_long, F.col("text")).alias("text"))
    return G.normalize_unicode(gated, "text", "normal").select("query_id", "too_long", "normal")


def _unless_long(value: Column, for_long) -> Column:
    return F.when(F.col("too_long"), F.lit(for_long)).otherwise(value)


def _all_matches(df: DataFrame) -> DataFrame:
    hits = F.when(~F.col("too_long"), G.matched_rules(F.col("normal"), S.INJECTION_RULES))
    return df.select("query_id", "too_long", hits.alias("hits"))


def query_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Every third question is padded with blanks, every seventh holds a NUL."""
    key = F.col("query_id")
    text = (
        F.when(key % 7 == 0, F.concat("text", F.char(F.lit(0)), F.lit("x")))
        .when(key % 3 == 0, F.concat(F.lit(" \t "), "text", F.lit("  \n")))
        .otherwise(F.col("text"))
    )
    rows = D.questions(spark, sf).select("query_id", text.alias("raw"))
    return rows.select(
        "query_id", G.validated(F.col("raw")).alias("reject_reason"),
        F.when(G.validated(F.col("raw")).isNull(), F.length(T.strip(F.col("raw"))))
        .cast("long").alias("chars"),
    )


def request_bounds(spark: SparkSession, sf: str) -> DataFrame:
    top_k = F.col("query_id") % 23
    return D.questions(spark, sf).select(
        "query_id", top_k.alias("top_k"), G.request_problem(F.col("text"), top_k).alias("problem")
    )


def length_gate(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length(T.strip(F.col("text")))
    return D.questions(spark, sf).select("query_id", size.alias("n")).select(
        "query_id", F.col("n").cast("long").alias("chars"),
        F.when(F.col("n") > S.MAX_QUERY_CHARS, S.LENGTH_RULE).alias("rule"),
        F.when(F.col("n") > S.MAX_QUERY_CHARS, 100).cast("long").alias("score"),
    )


def query_hash(spark: SparkSession, sf: str) -> DataFrame:
    return D.questions(spark, sf).select(
        "query_id", F.sha2(T.strip(F.col("text")), 256).alias("query_hash")
    ).withColumn("short_hash", F.substring("query_hash", 1, 16))


def nfc_strip(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.questions(spark, sf)
    return G.normalize_unicode(rows, "text", "normal").select(
        "query_id", F.length("normal").cast("long").alias("chars"),
        F.sha2("normal", 256).alias("sha"),
    )


def signature_hits(spark: SparkSession, sf: str) -> DataFrame:
    """All rules found in a question, before the early exit."""
    return _all_matches(_prepared(spark, sf)).select(
        "query_id",
        _unless_long(F.array_join(F.col("hits").cast("array<string>"), ","), S.LENGTH_RULE).alias("hits"),
    )


def early_exit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _all_matches(_prepared(spark, sf))
    cut = rows.withColumn("kept", G.until_critical(F.col("hits"), S.INJECTION_RULES))
    return cut.select(
        "query_id",
        _unless_long(F.array_join(F.col("kept").cast("array<string>"), ","), S.LENGTH_RULE).alias("kept"),
        _unless_long(F.size("hits") - F.size("kept"), 0).cast("long").alias("skipped"),
    )


def entropy_score(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents and pages, also those beyond the length limit."""
    rows = D.questions(spark, sf).withColumn("entropy", char_entropy(F.col("text")))
    return rows.select(
        "query_id", F.round("entropy", ENTROPY_PLACES).alias("entropy"),
        F.when(F.length("text") < S.ENTROPY_MIN_CHARS, 0)
        .otherwise(level_score(F.col("entropy"))).cast("long").alias("score"),
    )


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    scored = G.score_threats(_prepared(spark, sf), "normal")
    return scored.withColumn("score", _unless_long(F.col("score"), 100)).withColumn(
        "threat_level", _unless_long(F.col("threat_level"), "BLOCKED"))


def entropy_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "query_id",
        _unless_long(T.rendered(F.col("triggered_rules")), S.LENGTH_RULE).alias("triggered_rules"),
    )


def threat_level(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "query_id", F.col("score").cast("long").alias("score"), "threat_level",
        G.threat_rank(F.col("threat_level")).cast("long").alias("threat_rank"),
    )


def block_decision(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("score")
    return _scored(spark, sf).select(
        "query_id", "threat_level", G.is_blocked(score, True).alias("blocked_strict"),
        G.is_blocked(score, False).alias("blocked_permissive"),
    )


def sanitize_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.questions(spark, sf).select("query_id", G.sanitize(F.col("text")).alias("clean"))
    return rows.select(
        "query_id", F.length("clean").cast("long").alias("chars"), F.sha2("clean", 256).alias("sha")
    )


def gateway(spark: SparkSession, sf: str) -> DataFrame:
    return G.evaluate(D.questions(spark, sf)).select(
        "query_id", "query_hash", "threat_level", "score",
        T.rendered(F.col("triggered_rules")).alias("triggered_rules"), "blocked",
        "rejection_reason", F.sha2("sanitized_text", 256).alias("sanitized_sha"),
    )


def gateway_permissive(spark: SparkSession, sf: str) -> DataFrame:
    return G.evaluate(D.questions(spark, sf), strict=False).select(
        "query_id", "threat_level", "score", "blocked", "rejection_reason",
        F.sha2("sanitized_text", 256).alias("sanitized_sha"),
    )


def rejections(spark: SparkSession, sf: str) -> DataFrame:
    return G.rejections(G.evaluate(D.questions(spark, sf)), "query_id")


def violations_total(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.violations_total(G.evaluate(D.questions(spark, sf)))


def rule_triggers_total(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rule_triggers_total(G.evaluate(D.questions(spark, sf)))


def rag_queries_total(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rag_queries_total(G.evaluate(D.questions(spark, sf)))


#: A user's catalogue in place of the given one.
OWN_RULES = (S.Rule("ending", r"tion |ent\.", 30), S.Rule("double", r"ee|\n", 55))


def own_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = text_table(spark, sf, "conversations", "conv_id", "turn", "text")
    hits = G.matched_rules(F.col("text"), OWN_RULES)
    return rows.select("conv_id", "turn", *[
        F.array_contains(hits, F.lit(i)).alias(rule.label) for i, rule in enumerate(OWN_RULES)])


QUERIES = {
    f.__name__: f
    for f in (query_validate, request_bounds, length_gate, query_hash, nfc_strip, signature_hits,
              early_exit, entropy_score, entropy_rule, threat_level, block_decision,
              sanitize_query, gateway, gateway_permissive, rejections, violations_total,
              rule_triggers_total, rag_queries_total, own_rules)
}


def _found(pattern: str) -> str:
    body = pattern.replace(r"[\s\S]", "(?s:.)").replace(r"\s", SP).replace("'", "''")
    return f"regexp_matches(normal, '(?i){body}')"


def _sql_hit(index: int) -> str:
    """SQL test for one signature; the word edges and the back-reference need another form."""
    rule = S.INJECTION_RULES[index]
    if rule.label == "jailbreak_dan":
        return _found(rf"{EDGE_L}(DAN|do\s+anything\s+now){EDGE_R}")
    if rule.per_line:
        return "query_id IN (SELECT query_id FROM flooded)"
    return _found(rule.pattern)


# Ten copies of at least five characters repeat 21 or more substrings of 25 characters.
# Ten copies of a unit of p characters make the text at some multiple of p agree with the
# text p further on; around each place where the next 20 characters agree, every start
# is compared in full.
_FLOOD = """line_u AS (
  SELECT query_id, unnest(string_split(normal, chr(10))) AS line FROM prepared
), line AS (
  SELECT query_id, line, length(line) AS n, row_number() OVER () AS line_no
  FROM line_u WHERE length(line) >= 50
), dense AS (
  SELECT * FROM line WHERE n - 24 - len(list_distinct(list_transform(
    range(1, n - 23), lambda i: substr(line, i, 25)))) >= 21
), gram AS (
  SELECT line_no, unnest(range(n)) AS at,
         unnest(list_transform(range(1, n + 1), lambda i: substr(line, i, 20))) AS g FROM dense
), place AS (
  SELECT line_no, n, p, unnest(range(0, n - 9 * p + 1, p)) AS a
  FROM (SELECT line_no, n, unnest(range(5, n // 10 + 1)) AS p FROM dense)
), near AS (
  SELECT l.query_id, l.line, l.n, q.p, q.a FROM place q
  JOIN gram x ON x.line_no = q.line_no AND x.at = q.a
  JOIN gram y ON y.line_no = q.line_no AND y.at = q.a + q.p AND y.g = x.g
  JOIN dense l ON l.line_no = q.line_no
), start AS (
  SELECT *, unnest(range(greatest(0, a - p + 1), least(a, n - 10 * p) + 1)) AS s FROM near
), flooded AS (
  SELECT DISTINCT query_id FROM start
  WHERE substr(line, s + 1, 9 * p) = substr(line, s + p + 1, 9 * p)
)"""
_PREPARED = f"""{D.QUESTIONS}, stripped AS (
  SELECT query_id, {sql_strip('text')} AS text FROM questions
), prepared AS (
  SELECT query_id, regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{7f}}-\\x{{9f}}]', '', 'g') AS normal
  FROM stripped WHERE length(text) <= {S.MAX_QUERY_CHARS}
)"""
_LONG = f"FROM stripped WHERE length(text) > {S.MAX_QUERY_CHARS}"
_HIT_LIST = ", ".join(
    f"CASE WHEN {_sql_hit(i)} THEN {i} END" for i in range(len(S.INJECTION_RULES))
)
_MATCHED = f"""{_PREPARED}, {_FLOOD}, matched AS (
  SELECT query_id, normal,
         list_filter([{_HIT_LIST}], lambda x: x IS NOT NULL) AS hits FROM prepared
), cut AS (
  SELECT *, CASE WHEN list_contains(hits, 0) THEN hits[:1]
                 WHEN list_contains(hits, 1) THEN hits[:1] ELSE hits END AS kept FROM matched
)"""
_ENTROPY = """CASE WHEN length({t}) = 0 THEN 0.0
 ELSE list_aggregate(string_split({t}, ''), 'entropy') END"""
_LABELS = "[" + ", ".join(f"'{r.label}'" for r in S.INJECTION_RULES) + "]"
_SEVERITIES = "[" + ", ".join(str(r.severity) for r in S.INJECTION_RULES) + "]"
_SCORED = f"""{_MATCHED}, measured AS (
  SELECT *, {_ENTROPY.format(t='normal')} AS entropy FROM cut
), graded AS (
  SELECT *, CASE WHEN length(normal) < 80 THEN 0 WHEN entropy > 5.2 THEN 70
                 WHEN entropy > 4.5 THEN 52 ELSE 0 END AS es FROM measured
), scored AS (
  SELECT query_id, normal, list_concat(list_transform(kept, lambda x: {_LABELS}[x + 1]),
         CASE WHEN es > 0 THEN ['high_entropy_payload'] ELSE [] END) AS rules,
         greatest(es, coalesce(list_max(list_transform(kept, lambda x: {_SEVERITIES}[x + 1])), 0))
         AS score
  FROM graded
), leveled AS (
  SELECT *, CASE WHEN score >= 80 THEN 'BLOCKED' WHEN score >= 60 THEN 'SUSPICIOUS'
            ELSE 'CLEAN' END AS threat_level FROM scored
)"""


def sql_sanitize(text: str) -> str:
    return sql_strip(
        f"regexp_replace(regexp_replace(regexp_replace({text}, '<[^>]{{0,500}}>', '', 'g'), "
        r"'\{\{(?s:.){0,200}?\}\}|\{%(?s:.){0,200}?%\}', '[REMOVED]', 'g'), "
        r"'[ \t]{4,}', '   ', 'g')"
    )


def sql_gateway(limit: int) -> str:
    return f"""{_SCORED}, decided AS (
  SELECT s.query_id, sha256(s.text) AS query_hash,
    CASE WHEN l.query_id IS NULL THEN 'BLOCKED' ELSE l.threat_level END AS threat_level,
    CAST(CASE WHEN l.query_id IS NULL THEN 100 ELSE l.score END AS BIGINT) AS score,
    CASE WHEN l.query_id IS NULL THEN ['char_limit_exceeded'] ELSE l.rules END AS rules,
    l.query_id IS NULL OR l.score >= {limit} AS blocked,
    CASE WHEN l.query_id IS NULL THEN 'Query exceeds maximum allowed length.'
         WHEN l.score >= {limit} THEN 'Query blocked by security policy.' END AS rejection_reason,
    CASE WHEN l.score < {limit} THEN {sql_sanitize('l.normal')} END AS sanitized_text
  FROM stripped s LEFT JOIN leveled l USING (query_id)
)"""


_STRICT = sql_gateway(S.SUSPICIOUS_SCORE)

ORACLE = {
    "own_rules": r"""SELECT conv_id, turn, regexp_matches(text, 'tion |ent\.', 'i') AS ending,
  regexp_matches(text, 'ee|\n', 'i') AS double FROM conversations""",
    "query_validate": f"""WITH {D.QUESTIONS}
SELECT query_id, CASE WHEN query_id % 7 = 0 THEN 'null_byte' END AS reject_reason,
       CASE WHEN query_id % 7 <> 0 THEN length({sql_strip('text')}) END AS chars
FROM questions""",
    "request_bounds": f"""WITH {D.QUESTIONS}
SELECT query_id, query_id % 23 AS top_k,
  CASE WHEN length(text) < 1 THEN 'query_too_short' WHEN length(text) > 8192 THEN 'query_too_long'
       WHEN query_id % 23 NOT BETWEEN 1 AND 20 THEN 'top_k_out_of_range' END AS problem
FROM questions""",
    "length_gate": f"""WITH {D.QUESTIONS}, n AS (
  SELECT query_id, length({sql_strip('text')}) AS chars FROM questions)
SELECT query_id, chars, CASE WHEN chars > 8192 THEN 'char_limit_exceeded' END AS rule,
       CAST(CASE WHEN chars > 8192 THEN 100 END AS BIGINT) AS score FROM n""",
    "query_hash": f"""WITH {D.QUESTIONS}, h AS (
  SELECT query_id, sha256({sql_strip('text')}) AS query_hash FROM questions)
SELECT query_id, query_hash, substr(query_hash, 1, 16) AS short_hash FROM h""",
    "nfc_strip": f"""WITH {D.QUESTIONS}, t AS (
  SELECT query_id, regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{7f}}-\\x{{9f}}]', '', 'g') AS t
  FROM questions)
SELECT query_id, length(t) AS chars, sha256(t) AS sha FROM t""",
    "signature_hits": f"""WITH {_MATCHED}
SELECT query_id, array_to_string(hits, ',') AS hits FROM cut
UNION ALL SELECT query_id, 'char_limit_exceeded' {_LONG}""",
    "early_exit": f"""WITH {_MATCHED}
SELECT query_id, array_to_string(kept, ',') AS kept, CAST(len(hits) - len(kept) AS BIGINT) AS skipped
FROM cut UNION ALL SELECT query_id, 'char_limit_exceeded', 0 {_LONG}""",
    "entropy_score": f"""WITH {D.QUESTIONS}, e AS (
  SELECT query_id, length(text) AS n, {_ENTROPY.format(t='text')} AS entropy FROM questions)
SELECT query_id, round(entropy, {ENTROPY_PLACES}) AS entropy,
  CAST(CASE WHEN n < 80 THEN 0 WHEN entropy > 5.2 THEN 70 WHEN entropy > 4.5 THEN 52 ELSE 0 END
       AS BIGINT) AS score FROM e""",
    "entropy_rule": f"""WITH {_SCORED}
SELECT query_id, array_to_string(rules, ',') AS triggered_rules FROM scored
UNION ALL SELECT query_id, 'char_limit_exceeded' {_LONG}""",
    "threat_level": f"""WITH {_SCORED}
SELECT query_id, CAST(score AS BIGINT) AS score, threat_level,
  CAST(CASE threat_level WHEN 'BLOCKED' THEN 2 WHEN 'SUSPICIOUS' THEN 1 ELSE 0 END AS BIGINT)
  AS threat_rank FROM leveled
UNION ALL SELECT query_id, 100, 'BLOCKED', 2 {_LONG}""",
    "block_decision": f"""WITH {_SCORED}
SELECT query_id, threat_level, score >= 60 AS blocked_strict, score >= 80 AS blocked_permissive
FROM leveled UNION ALL SELECT query_id, 'BLOCKED', true, true {_LONG}""",
    "sanitize_query": f"""WITH {D.QUESTIONS}, t AS (
  SELECT query_id, {sql_sanitize('text')} AS t FROM questions)
SELECT query_id, length(t) AS chars, sha256(t) AS sha FROM t""",
    "gateway": f"""WITH {_STRICT}
SELECT query_id, query_hash, threat_level, score, array_to_string(rules, ',') AS triggered_rules,
       blocked, rejection_reason, sha256(sanitized_text) AS sanitized_sha FROM decided""",
    "gateway_permissive": f"""WITH {sql_gateway(S.BLOCK_SCORE)}
SELECT query_id, threat_level, score, blocked, rejection_reason,
       sha256(sanitized_text) AS sanitized_sha FROM decided""",
    "rejections": f"""WITH {_STRICT}
SELECT query_id, rejection_reason AS detail, substr(query_hash, 1, 16) AS query_hash, threat_level
FROM decided WHERE blocked""",
    "violations_total": f"""WITH {_STRICT}
SELECT threat_level, count(*) AS value FROM decided WHERE blocked GROUP BY threat_level""",
    "rule_triggers_total": f"""WITH {_STRICT}, named AS (
  SELECT unnest(rules) AS rule FROM decided WHERE blocked)
SELECT rule, count(*) AS value FROM named GROUP BY rule""",
    "rag_queries_total": f"""WITH {_STRICT}
SELECT count(*) FILTER (WHERE NOT blocked) AS value FROM decided""",
}
