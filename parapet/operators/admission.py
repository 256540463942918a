"""Who may send a request, and how many: API keys, public paths, sliding quotas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions.text import non_empty
from parapet.operators.ordered import fitting_slice, timeline

# ---- fixed values ----
PUBLIC_PATHS = ("/health", "/ready", "/metrics", "/docs", "/openapi.json", "/redoc")
ANONYMOUS = "anonymous"
# ---- end of fixed values ----
MICROS = 1_000_000


@dataclass(frozen=True)
class QuotaPolicy:
    requests_per_window: int = 60
    window_seconds: int = 60
    burst: int = 0

    @property
    def limit(self) -> int:
        return self.requests_per_window + self.burst

    @property
    def slice_us(self) -> int:
        """Widest time slice that a key's requests are cut into; a busy key gets narrower ones."""
        return max(MICROS, self.window_seconds * MICROS // 4)


def is_public(path: Column) -> Column:
    return path.isin(list(PUBLIC_PATHS))


def quota_key(api_key: Column) -> Column:
    """Requests without a key share one quota."""
    return F.coalesce(api_key, F.lit(ANONYMOUS))


def masked(api_key: Column) -> Column:
    return F.substring(api_key, 1, 8)


def key_list(setting: Column) -> Column:
    """Keys of a comma-separated setting."""
    return non_empty(F.split(setting, ","))


def authenticate(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``authenticated``. The join side is left to the optimizer, which knows its size."""
    known = keys.select("api_key").where(F.col("api_key") != "").distinct()
    return log.join(known.withColumn("authenticated", F.lit(True)), "api_key", "left").withColumn(
        "authenticated", F.coalesce("authenticated", F.lit(False))
    )


def sliding_counts(log: DataFrame, policy: QuotaPolicy) -> DataFrame:
    """Add ``window_count`` and ``window_start`` per request.

    ``log`` holds unique ``request_id``, ``ts`` and ``api_key``. The window is closed at both ends,
    counts refused requests too, and orders requests of the same moment by id. A count is
    the key's arrivals up to the request minus those that had expired by then, so the cost
    does not depend on the window length or on how busy a key is.
    """
    moment = F.unix_micros("ts")
    window = F.lit(policy.window_seconds * MICROS)
    thin = log.select(
        quota_key(F.col("api_key")).alias("key"),
        F.col("request_id").alias("id"),
        F.explode(F.array(
            F.struct((moment - window).alias("at"), F.lit(0).alias("kind")),
            F.struct(moment.alias("at"), F.lit(1).alias("kind")),
        )).alias("event"),
    ).select("key", "event.at", "event.kind", "id")
    placed = timeline(thin, fitting_slice(thin, policy.slice_us))
    counts = placed.groupBy("id").agg(
        (F.max(F.when(F.col("kind") == 1, F.col("seen")))
         - F.max(F.when(F.col("kind") == 0, F.col("seen")))).alias("window_count"),
        F.timestamp_micros(F.max(F.when(F.col("kind") == 0, F.col("next_at"))))
        .alias("window_start"),
    )
    return log.join(counts.withColumnRenamed("id", "request_id"), "request_id")


def decide(counted: DataFrame, policy: QuotaPolicy) -> DataFrame:
    """Add ``allowed, remaining, reset_at, retry_after`` to counted requests."""
    allowed = F.col("window_count") <= policy.limit
    reset_at = F.timestamp_micros(
        F.unix_micros("window_start") + F.lit(policy.window_seconds * MICROS)
    )
    wait = (F.unix_micros("reset_at") - F.unix_micros("ts")) / MICROS
    return (
        counted.withColumn("allowed", allowed)
        .withColumn("remaining", F.greatest(F.lit(0), policy.limit - F.col("window_count")))
        .withColumn("reset_at", reset_at)
        .withColumn("retry_after", F.when(~F.col("allowed"), F.greatest(F.lit(0.0), wait)))
    )


def rate_limit(log: DataFrame, policy: QuotaPolicy) -> DataFrame:
    return decide(sliding_counts(log, policy), policy)


def peek(log: DataFrame, probes: DataFrame, policy: QuotaPolicy) -> DataFrame:
    """Quota of a key at a moment, without using any of it.

    ``probes`` holds unique ``probe_id``, ``api_key`` and ``ts``. Unlike a recorded request, a probe is
    allowed only below the limit. A key without requests has its whole quota.
    """
    moment, window = F.unix_micros("ts"), F.lit(policy.window_seconds * MICROS)
    arrivals = log.select(
        quota_key(F.col("api_key")).alias("key"), moment.alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("long").alias("id"),
    )
    asked = probes.select(
        quota_key(F.col("api_key")).alias("key"), F.col("probe_id").alias("id"),
        F.explode(F.array(
            F.struct((moment - window).alias("at"), F.lit(0).alias("kind")),
            F.struct(moment.alias("at"), F.lit(2).alias("kind")),
        )).alias("event"),
    ).select("key", "event.at", "event.kind", "id")
    events = arrivals.unionByName(asked)
    placed = timeline(events, fitting_slice(events, policy.slice_us)).where(F.col("kind") != 1)
    counts = placed.groupBy("id").agg(
        (F.max(F.when(F.col("kind") == 2, F.col("seen")))
         - F.max(F.when(F.col("kind") == 0, F.col("seen")))).alias("window_count"),
        F.max(F.when(F.col("kind") == 0, F.col("next_at"))).alias("_first"),
    ).withColumnRenamed("id", "probe_id")
    first = F.when(F.col("window_count") > 0, F.col("_first") + window)
    return probes.join(counts, "probe_id").select(
        *probes.columns, "window_count",
        (F.col("window_count") < policy.limit).alias("allowed"),
        F.greatest(F.lit(0), policy.limit - F.col("window_count")).alias("remaining"),
        F.timestamp_micros(F.coalesce(first, moment)).alias("reset_at"),
    )


def quota_headers(decided: DataFrame, policy: QuotaPolicy) -> DataFrame:
    """Add the report columns of a response.

    A wait of zero is reported as 1; a wait below one second as 0.
    """
    wait = F.col("retry_after")
    return decided.select(
        "*",
        F.lit(policy.requests_per_window).cast("long").alias("quota_limit"),
        F.col("remaining").cast("long").alias("quota_remaining"),
        F.floor(F.unix_micros("reset_at") / MICROS).cast("long").alias("quota_reset"),
        F.when(
            ~F.col("allowed"),
            F.when(F.coalesce(wait, F.lit(0.0)) == 0, 1).otherwise(F.floor(wait)),
        ).cast("long").alias("retry_after_s"),
    )
