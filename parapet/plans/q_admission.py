"""Queries over keys, paths and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.operators import admission as A
from parapet.plans import derived as D
from parapet.plans.admission import admit
from parapet.sources.tables import table

DAY = A.QuotaPolicy(3, 86_400)
DAY_BURST = A.QuotaPolicy(3, 86_400, 2)


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier numbers are the valid keys."""
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("api_key"))


def sliding_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.sliding_counts(D.requests(spark, sf), DAY).select(
        "request_id", "window_count", F.unix_micros("window_start").alias("window_start_us")
    )


def rate_decision(spark: SparkSession, sf: str) -> DataFrame:
    return A.rate_limit(D.requests(spark, sf), DAY_BURST).select(
        "request_id", "window_count", "allowed", F.col("remaining").cast("long").alias("remaining")
    )


def rate_reset(spark: SparkSession, sf: str) -> DataFrame:
    return A.rate_limit(D.requests(spark, sf), DAY).select(
        "request_id", F.unix_micros("reset_at").alias("reset_us"),
        F.round("retry_after", 6).alias("retry_after"),
    )


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer asks for its quota once, spread over the month."""
    key = F.col("c_custkey")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "customer").select(
        key.alias("probe_id"), (key % 200).cast("string").alias("api_key"),
        F.timestamp_micros(start + (key * 7_919 % 2_500_000) * 1_000_000).alias("ts"),
    )


def rate_peek(spark: SparkSession, sf: str) -> DataFrame:
    return A.peek(D.requests(spark, sf), _probes(spark, sf), DAY).select(
        "probe_id", "window_count", "allowed", F.col("remaining").cast("long").alias("remaining"),
        F.unix_micros("reset_at").alias("reset_us"),
    )


def rate_headers(spark: SparkSession, sf: str) -> DataFrame:
    decided = A.rate_limit(D.requests(spark, sf), DAY_BURST)
    return A.quota_headers(decided, DAY_BURST).select(
        "request_id", "quota_limit", "quota_remaining", "quota_reset", "retry_after_s"
    )


def auth_split(spark: SparkSession, sf: str) -> DataFrame:
    return A.authenticate(D.requests(spark, sf), _keys(spark, sf)).select(
        "request_id", "authenticated"
    )


def public_paths(spark: SparkSession, sf: str) -> DataFrame:
    return D.requests(spark, sf).groupBy(A.is_public(F.col("path")).alias("public")).agg(
        F.count("*").alias("requests")
    )


def anon_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Failed requests carry no key and share one quota."""
    log = D.requests(spark, sf).withColumn(
        "api_key", F.when(F.col("status") != 500, F.col("api_key"))
    )
    return A.rate_limit(log, DAY).select(
        "request_id", A.quota_key(F.col("api_key")).alias("quota_key"), "window_count", "allowed"
    )


def mask_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        "c_custkey", A.masked(F.concat(F.col("c_custkey").cast("string"), "c_name")).alias("masked")
    )


def admission(spark: SparkSession, sf: str) -> DataFrame:
    return admit(D.requests(spark, sf), _keys(spark, sf), DAY_BURST).select(
        "request_id", F.col("admission_status").cast("long").alias("admission_status")
    )


QUERIES = {
    f.__name__: f
    for f in (sliding_count, rate_decision, rate_reset, rate_peek, rate_headers, auth_split,
              public_paths, anon_quota, mask_keys, admission)
}


def sql_counted(source: str, key: str = "api_key") -> str:
    return f"""counted AS (
  SELECT *, count(*) OVER w AS window_count, min(ts) OVER w AS window_start FROM {source}
  WINDOW w AS (PARTITION BY {key} ORDER BY ts
               RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
)"""


_COUNTED = f"{D.REQUESTS}, {sql_counted('requests')}"
_RESET = "epoch_us(window_start) + 86400000000"
_WAIT = f"CASE WHEN window_count > {{n}} THEN greatest(0, {_RESET} - epoch_us(ts)) END"
_PUBLIC = "path IN (" + ", ".join(f"'{p}'" for p in A.PUBLIC_PATHS) + ")"
_KEYS = "(SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"

ORACLE = {
    "sliding_count": f"""WITH {_COUNTED}
SELECT request_id, window_count, epoch_us(window_start) AS window_start_us FROM counted""",
    "rate_decision": f"""WITH {_COUNTED}
SELECT request_id, window_count, window_count <= 5 AS allowed,
       greatest(0, 5 - window_count) AS remaining FROM counted""",
    "rate_reset": f"""WITH {_COUNTED}
SELECT request_id, {_RESET} AS reset_us,
       round(CAST({_WAIT.format(n=3)} AS DOUBLE) / 1000000, 6) AS retry_after FROM counted""",
    "rate_peek": f"""WITH {D.REQUESTS}, probes AS (
  SELECT c_custkey AS probe_id, CAST(c_custkey % 200 AS VARCHAR) AS api_key,
         TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 7919 % 2500000) AS ts FROM customer
), met AS (
  SELECT p.probe_id, any_value(p.ts) AS ts, count(r.ts) AS n, min(r.ts) AS first_ts
  FROM probes p LEFT JOIN requests r
    ON r.api_key = p.api_key AND r.ts BETWEEN p.ts - INTERVAL 1 DAY AND p.ts
  GROUP BY p.probe_id
)
SELECT probe_id, n AS window_count, n < 3 AS allowed, greatest(0, 3 - n) AS remaining,
       CASE WHEN n > 0 THEN epoch_us(first_ts) + 86400000000 ELSE epoch_us(ts) END AS reset_us
FROM met""",
    "rate_headers": f"""WITH {_COUNTED}
SELECT request_id, CAST(3 AS BIGINT) AS quota_limit,
       greatest(0, 5 - window_count) AS quota_remaining,
       CAST(floor(({_RESET}) / 1000000) AS BIGINT) AS quota_reset,
       CAST(CASE WHEN {_WAIT.format(n=5)} = 0 THEN 1
            ELSE floor({_WAIT.format(n=5)} / 1000000) END AS BIGINT) AS retry_after_s
FROM counted""",
    "auth_split": f"""WITH {D.REQUESTS}
SELECT request_id, api_key IN {_KEYS} AS authenticated FROM requests""",
    "public_paths": f"""WITH {D.REQUESTS}
SELECT {_PUBLIC} AS public, count(*) AS requests FROM requests GROUP BY 1""",
    "anon_quota": f"""WITH {D.REQUESTS}, keyed AS (
  SELECT request_id, ts, CASE WHEN status = 500 THEN 'anonymous' ELSE api_key END AS quota_key
  FROM requests
), {sql_counted('keyed', 'quota_key')}
SELECT request_id, quota_key, window_count, window_count <= 3 AS allowed FROM counted""",
    "mask_keys": """SELECT c_custkey, substr(c_custkey || c_name, 1, 8) AS masked FROM customer""",
    "admission": f"""WITH {D.REQUESTS}, judged AS (
  SELECT *, {_PUBLIC} AS public, api_key IN {_KEYS} AS known FROM requests
), metered AS (SELECT * FROM judged WHERE known AND NOT public), {sql_counted('metered')}
SELECT j.request_id, CAST(CASE WHEN public THEN j.status WHEN NOT known THEN 403
       WHEN c.window_count > 5 THEN 429 ELSE j.status END AS BIGINT) AS admission_status
FROM judged j LEFT JOIN (SELECT request_id, window_count FROM counted) c USING (request_id)""",
}
