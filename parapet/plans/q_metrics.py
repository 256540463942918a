"""Queries over counters, rates, quantiles and alerts. Times are epoch microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.functions import histogram as H
from parapet.operators import alerts, metrics as M
from parapet.plans import derived as D
from parapet.sources.tables import table

PLACES = 6
# Lower limits than the defaults: the event table is sparse, and its durations are short.
QUERY_P95_SECONDS = 2.0
QUERY_VIOLATION_RATE = 0.002


def _at(df: DataFrame) -> DataFrame:
    return df.withColumn("at", F.unix_micros("at")).withColumnRenamed("at", "at_us")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.withColumn(column, F.round(column, PLACES))
    return df


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    return D.security_log(spark, sf).where("blocked")


def _reflections(spark: SparkSession, sf: str) -> DataFrame:
    return D.security_log(spark, sf).where("reflection_detected")


def route_template(spark: SparkSession, sf: str) -> DataFrame:
    return D.requests(spark, sf).groupBy(
        M.route_template(F.col("path")).alias("path"), "method"
    ).agg(F.count("*").alias("value"))


def requests_total(spark: SparkSession, sf: str) -> DataFrame:
    return M.requests_total(D.requests(spark, sf))


def duration_histogram(spark: SparkSession, sf: str) -> DataFrame:
    log = D.requests(spark, sf).withColumn("path", M.route_template(F.col("path")))
    return _rounded(M.duration_histogram(log, "method", "path"), "value")


def response_times(spark: SparkSession, sf: str) -> DataFrame:
    """Durations in half microseconds, so that both engines round the same way."""
    log = D.requests(spark, sf).withColumn("duration_s", F.round("duration_s", 4))
    return M.response_times(log).select("request_id", "duration_ms")


def request_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_at(M.request_rate(D.requests(spark, sf))), "rate")


def error_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_at(M.error_ratio(D.requests(spark, sf))), "error_ratio")


def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.latency_quantiles(D.requests(spark, sf), 3600, 900)
    return _rounded(_at(rows), "p50", "p95", "p99")


def blocked_5m(spark: SparkSession, sf: str) -> DataFrame:
    return _at(M.increase(_violations(spark, sf), 300, 60))


def rate_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_at(M.request_rate(D.requests(spark, sf), by=["status"])), "rate").withColumn(
        "status", F.col("status").cast("long")
    )


def rate_by_route(spark: SparkSession, sf: str) -> DataFrame:
    log = D.requests(spark, sf).withColumn("path", M.route_template(F.col("path")))
    return _rounded(_at(M.request_rate(log, by=["path", "method"])), "rate")


def violations_by_level(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.request_rate(_violations(spark, sf), 300, 60, ["threat_level"])
    return _rounded(_at(rows), "rate")


def top_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _at(M.top_rules(_violations(spark, sf), 10, 86_400, 86_400))


def reflections_5m(spark: SparkSession, sf: str) -> DataFrame:
    return _at(M.increase(_reflections(spark, sf), 300, 60))


def rag_rate(spark: SparkSession, sf: str) -> DataFrame:
    answered = D.security_log(spark, sf).where(~F.col("blocked"))
    return _rounded(_at(M.request_rate(answered)), "rate")


def alert_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _at(alerts.high_error_rate(D.requests(spark, sf), hold_s=120))


def alert_error_rate_given(spark: SparkSession, sf: str) -> DataFrame:
    """The three alerts below and this one run with the values of the rules."""
    return _at(alerts.high_error_rate(D.requests(spark, sf)))


def alert_p95_given(spark: SparkSession, sf: str) -> DataFrame:
    return _at(alerts.high_p95(D.requests(spark, sf)))


def alert_violations_given(spark: SparkSession, sf: str) -> DataFrame:
    return _at(alerts.violation_spike(_violations(spark, sf)))


SLOWER, DENSER = 4.0, 1_000


def alert_p95_slow(spark: SparkSession, sf: str) -> DataFrame:
    """The given threshold and hold time, on the whole log with four times the durations."""
    return _at(alerts.high_p95(D.requests(spark, sf).withColumn("duration_s", F.col("duration_s") * SLOWER)))


def alert_violations_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The given rate and hold time, on all violations within a thousandth of their time."""
    dense = F.timestamp_micros(F.floor(F.unix_micros("ts") / DENSER))
    return _at(alerts.violation_spike(_violations(spark, sf).withColumn("ts", dense)))


def alert_absence(spark: SparkSession, sf: str) -> DataFrame:
    rows = alerts.absent(D.requests(spark, sf), "method")
    rows = rows.unionByName(alerts.absent(D.requests(spark, sf), "api_key"))
    times = ("last_seen", "firing_from", "seen_again")
    return rows.select("target", *[F.unix_micros(t).alias(f"{t}_us") for t in times])


def alert_p95(spark: SparkSession, sf: str) -> DataFrame:
    return _at(alerts.high_p95(D.requests(spark, sf), QUERY_P95_SECONDS, 300))


def alert_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _at(alerts.violation_spike(_violations(spark, sf), QUERY_VIOLATION_RATE, 120))


def alert_reflection(spark: SparkSession, sf: str) -> DataFrame:
    return _at(alerts.reflection_seen(_reflections(spark, sf)))


def threshold_bands(spark: SparkSession, sf: str) -> DataFrame:
    log = D.requests(spark, sf)
    rows = M.tiles(log, F.col("status") == 500, 3600, 3600)
    return _rounded(_at(rows), "request_rate", "error_ratio", "p95")


def counter_increase(spark: SparkSession, sf: str) -> DataFrame:
    """The event number within its thousand is a counter that starts again every thousand."""
    samples = table(spark, sf, "events").select(
        F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 1000).alias("value"),
    )
    return _at(M.counter_increase(samples))


QUERIES = {
    f.__name__: f
    for f in (route_template, requests_total, duration_histogram, response_times, request_rate,
              error_ratio, latency_quantiles, blocked_5m, rate_by_status, rate_by_route,
              violations_by_level, top_rules, reflections_5m, rag_rate, alert_error_rate,
              alert_error_rate_given, alert_p95_given, alert_violations_given, alert_p95_slow, alert_violations_dense, alert_absence, alert_p95, alert_violations, alert_reflection, threshold_bands,
              counter_increase)
}

_TEMPLATED = f"""{D.REQUESTS}, templated AS (
  SELECT * REPLACE (CASE WHEN regexp_matches(path, '^/api/v1/documents/[^/]+$')
                    THEN '/api/v1/documents/{{doc_id}}' ELSE path END AS path) FROM requests
)"""
_VIOLATIONS = f"{D.SECURITY_LOG}, violations AS (SELECT * FROM security_log WHERE blocked)"
_REFLECTIONS = (
    f"{D.SECURITY_LOG}, reflections AS (SELECT * FROM security_log WHERE reflection_detected)"
)


def sql_points(source: str, length_s: int, step_s: int, amounts: dict[str, str], by=()) -> str:
    """CTE ``points``: every point of the grid joined with the rows of its window."""
    keys = "".join(f"{k}, " for k in by)
    sums = ", ".join(f"CAST(sum({a}) AS BIGINT) AS {n}" for n, a in amounts.items())
    length, step = length_s * 1_000_000, step_s * 1_000_000
    return f"""points AS (
  SELECT at_us, {keys}{sums}
  FROM (SELECT *, unnest(range(
          CAST(ceil(epoch_us(ts) / {step}.0) AS BIGINT) * {step},
          CAST(ceil(epoch_us(ts) / {step}.0) AS BIGINT) * {step} + {length}, {step})) AS at_us
        FROM {source})
  GROUP BY ALL
)"""


def sql_rate(source: str, length_s: int, step_s: int, by=()) -> str:
    keys = "".join(f"{k}, " for k in by)
    return (
        f"{sql_points(source, length_s, step_s, {'n': '1'}, by)}, rates AS ("
        f"SELECT at_us, {keys}round(n / {length_s}.0::DOUBLE, {PLACES}) AS rate FROM points)"
    )


_BUCKETS = {f"le_{i}": f"CASE WHEN duration_s <= {b} THEN 1 ELSE 0 END"
            for i, b in enumerate(H.BOUNDS)}
_CUM = ", ".join(f"le_{i}" for i in range(len(H.BOUNDS)))


def sql_quantile(q: float) -> str:
    """Quantile from the cumulative counts ``le_i`` and the total ``n``."""
    cases = ""
    lower, below = "0.0", "0"
    for i, bound in enumerate(H.BOUNDS):
        cases += (
            f" WHEN le_{i} >= {q}::DOUBLE * n THEN {lower} + ({bound} - {lower}) * "
            f"(CASE WHEN le_{i} > {below} THEN ({q}::DOUBLE * n - {below})::DOUBLE "
            f"/ (le_{i} - {below}) ELSE 1.0 END)"
        )
        lower, below = str(bound), f"le_{i}"
    return f"CAST(CASE{cases} ELSE {H.BOUNDS[-1]} END AS DOUBLE)"


def sql_held(condition: str, hold_s: int, step_s: int = 30) -> str:
    """CTE ``fired``: a run of true points that covers the hold time, by window frames."""
    hold = hold_s * 1_000_000
    return f"""truths AS (SELECT at_us FROM points WHERE {condition}), fired AS (
  SELECT at_us FROM (SELECT at_us, count(*) OVER (ORDER BY at_us
    RANGE BETWEEN {hold} PRECEDING AND CURRENT ROW) AS c FROM truths)
  WHERE c = {hold_s // step_s + 1}
)"""


_BAND = {
    name: f"CASE WHEN {name} >= {red} THEN 'red' WHEN {name} >= {yellow} THEN 'yellow' "
          f"ELSE 'green' END AS {name}_band"
    for name, (yellow, red) in M.BANDS.items()
}
_HISTOGRAM_ROWS = " UNION ALL ".join(
    f"SELECT method, path, '{name}' AS le, CAST(count(*) FILTER (WHERE duration_s <= {name}) "
    f"AS DOUBLE) AS value FROM templated GROUP BY method, path" for name in H.BOUND_NAMES[:-1]
)

ORACLE = {
    "route_template": f"""WITH {_TEMPLATED}
SELECT path, method, count(*) AS value FROM templated GROUP BY path, method""",
    "requests_total": f"""WITH {_TEMPLATED}
SELECT method, path, CAST(status AS VARCHAR) AS status, count(*) AS value FROM templated
GROUP BY method, path, status""",
    "duration_histogram": f"""WITH {_TEMPLATED}
{_HISTOGRAM_ROWS}
UNION ALL SELECT method, path, '+Inf', count(*) FROM templated GROUP BY method, path
UNION ALL SELECT method, path, 'count', count(*) FROM templated GROUP BY method, path
UNION ALL SELECT method, path, 'sum', round(sum(duration_s), {PLACES}) FROM templated
GROUP BY method, path""",
    "response_times": f"""WITH {D.REQUESTS}
SELECT request_id, round(round(duration_s, 4) * 1000, 2) AS duration_ms FROM requests""",
    "request_rate": f"""WITH {D.REQUESTS}, {sql_rate('requests', 60, 60)} SELECT * FROM rates""",
    "error_ratio": f"""WITH {D.REQUESTS}, {sql_points('requests', 300, 60, {
        'n': '1', 'errors': 'CASE WHEN status >= 500 THEN 1 ELSE 0 END'})}
SELECT at_us, round((errors / 300.0::DOUBLE) / greatest(n / 300.0::DOUBLE, 0.001::DOUBLE),
       {PLACES}) AS error_ratio FROM points""",
    "latency_quantiles": f"""WITH {D.REQUESTS},
{sql_points('requests', 3600, 900, {'n': '1', **_BUCKETS})}
SELECT at_us, round({sql_quantile(0.5)}, {PLACES}) AS p50,
       round({sql_quantile(0.95)}, {PLACES}) AS p95, round({sql_quantile(0.99)}, {PLACES}) AS p99
FROM points""",
    "blocked_5m": f"""WITH {_VIOLATIONS}, {sql_points('violations', 300, 60, {'value': '1'})}
SELECT * FROM points""",
    "rate_by_status": f"""WITH {D.REQUESTS}, {sql_rate('requests', 60, 60, ['status'])}
SELECT at_us, CAST(status AS BIGINT) AS status, rate FROM rates""",
    "rate_by_route": f"""WITH {_TEMPLATED}, {sql_rate('templated', 60, 60, ['path', 'method'])}
SELECT * FROM rates""",
    "violations_by_level": f"""WITH {_VIOLATIONS},
{sql_rate('violations', 300, 60, ['threat_level'])} SELECT * FROM rates""",
    "top_rules": f"""WITH {_VIOLATIONS},
{sql_points('violations', 86_400, 86_400, {'value': '1'}, ['rule'])}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY at_us ORDER BY value DESC, rule) AS rank FROM points
) SELECT * FROM ordered WHERE rank <= 10""",
    "reflections_5m": f"""WITH {_REFLECTIONS}, {sql_points('reflections', 300, 60, {'value': '1'})}
SELECT * FROM points""",
    "rag_rate": f"""WITH {D.SECURITY_LOG}, answered AS (SELECT * FROM security_log WHERE NOT blocked),
{sql_rate('answered', 60, 60)} SELECT * FROM rates""",
    "alert_error_rate": f"""WITH {D.REQUESTS}, {sql_points('requests', 300, 30, {
        'n': '1', 'errors': 'CASE WHEN status >= 500 THEN 1 ELSE 0 END'})},
{sql_held('errors::DOUBLE / n > 0.05', 120)} SELECT at_us FROM fired""",
    "alert_error_rate_given": f"""WITH {D.REQUESTS}, {sql_points('requests', 300, 30, {
        'n': '1', 'errors': 'CASE WHEN status >= 500 THEN 1 ELSE 0 END'})},
{sql_held('errors::DOUBLE / n > 0.05', 300)} SELECT at_us FROM fired""",
    "alert_p95_given": f"""WITH {D.REQUESTS}, {sql_points('requests', 300, 30, {'n': '1', **_BUCKETS})},
{sql_held(f'{sql_quantile(0.95)} > 5', 600)} SELECT at_us FROM fired""",
    "alert_violations_given": f"""WITH {_VIOLATIONS}, {sql_points('violations', 300, 30, {'n': '1'})},
{sql_held('n / 300.0 > 0.2', 300)} SELECT at_us FROM fired""",
    "alert_p95_slow": f"""WITH {D.REQUESTS}, slow AS (
  SELECT * REPLACE (duration_s * {SLOWER}::DOUBLE AS duration_s) FROM requests
), {sql_points('slow', 300, 30, {'n': '1', **_BUCKETS})},
{sql_held(f'{sql_quantile(0.95)} > 5', 600)} SELECT at_us FROM fired""",
    "alert_violations_dense": f"""WITH {_VIOLATIONS}, dense AS (
  SELECT * REPLACE (make_timestamp(epoch_us(ts) // {DENSER}) AS ts) FROM violations
), {sql_points('dense', 300, 30, {'n': '1'})},
{sql_held('n / 300.0 > 0.2', 300)} SELECT at_us FROM fired""",
    "alert_absence": f"""WITH {D.REQUESTS}, seen AS (
  SELECT DISTINCT kind, target, at_us FROM (
    SELECT 0 AS kind, method AS target, CAST(ceil(epoch_us(ts) / 30000000.0) AS BIGINT) * 30000000 AS at_us FROM requests
    UNION ALL SELECT 1, api_key, CAST(ceil(epoch_us(ts) / 30000000.0) AS BIGINT) * 30000000 FROM requests)
), gaps AS (
  SELECT target, lag(at_us) OVER (PARTITION BY kind, target ORDER BY at_us) AS last_us, at_us FROM seen
), still AS (
  SELECT target, max(at_us) AS last_us, (SELECT max(at_us) FROM seen) AS end_us FROM seen GROUP BY kind, target
)
SELECT target, last_us AS last_seen_us, last_us + 150000000 AS firing_from_us,
       at_us AS seen_again_us FROM gaps WHERE last_us + 150000000 < at_us
UNION ALL SELECT target, last_us, last_us + 150000000, NULL FROM still WHERE last_us + 150000000 < end_us""",
    "alert_p95": f"""WITH {D.REQUESTS}, {sql_points('requests', 300, 30, {'n': '1', **_BUCKETS})},
{sql_held(f'{sql_quantile(0.95)} > {QUERY_P95_SECONDS}', 300)} SELECT at_us FROM fired""",
    "alert_violations": f"""WITH {_VIOLATIONS}, {sql_points('violations', 300, 30, {'n': '1'})},
{sql_held(f'n / 300.0 > {QUERY_VIOLATION_RATE}', 120)} SELECT at_us FROM fired""",
    "alert_reflection": f"""WITH {_REFLECTIONS},
{sql_points('reflections', 600, 30, {'value': '1'})}, {sql_held('value > 0', 60)}
SELECT at_us FROM fired""",
    "threshold_bands": f"""WITH {D.REQUESTS}, {sql_points('requests', 3600, 3600, {
        'n': '1', 'errors': 'CASE WHEN status >= 500 THEN 1 ELSE 0 END', **_BUCKETS})},
figures AS (
  SELECT at_us, n / 3600.0::DOUBLE AS request_rate,
         (errors / 3600.0::DOUBLE) / greatest(n / 3600.0::DOUBLE, 0.001::DOUBLE) AS error_ratio,
         {sql_quantile(0.95)} AS p95, errors AS blocked FROM points
)
SELECT at_us, round(request_rate, {PLACES}) AS request_rate,
       round(error_ratio, {PLACES}) AS error_ratio, round(p95, {PLACES}) AS p95, blocked,
       {', '.join(_BAND.values())} FROM figures""",
    "counter_increase": f"""WITH stepped AS (
  SELECT event_type AS series, ts, event_id % 1000 AS value,
         lag(event_id % 1000) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events
), gains AS (
  SELECT series, ts, CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value
         ELSE value - before END AS gain FROM stepped
), {sql_points('gains', 3600, 3600, {'increase': 'gain'}, ['series'])}
SELECT * FROM points""",
}
