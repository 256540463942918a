"""Alert rules: a condition on an evaluation grid that must hold for some time.

The grid is evaluated on per-step sums, so its size follows the time span and not the
number of requests.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions import histogram as H
from parapet.operators import metrics as M
from parapet.operators.ordered import previous_value

# ---- fixed values: evaluation step, thresholds and hold times in seconds ----
STEP_S = 30
ERROR_RATIO, ERROR_HOLD_S = 0.05, 300
ABSENT_HOLD_S = 120
P95_SECONDS, P95_HOLD_S = 5, 600
VIOLATION_RATE, VIOLATION_HOLD_S = 0.2, 300
REFLECTION_WINDOW_S, REFLECTION_HOLD_S = 600, 60
# ---- end of fixed values ----
MICROS = 1_000_000


def held(points: DataFrame, condition: Column, hold_s: int, step_s: int = STEP_S) -> DataFrame:
    """Points at which the condition was true now and at every step of the hold time.

    A missing point is not true. Each true point vouches for the steps it supports; a
    point fires when all of its supporters have reported.
    """
    needed = hold_s // step_s + 1
    moment = F.unix_micros("at")
    supported = F.array(*[moment + F.lit(i * step_s * MICROS) for i in range(needed)])
    return (
        points.where(condition)
        .select(F.explode(supported).alias("_at"))
        .groupBy("_at").agg(F.count("*").alias("_n"))
        .where(F.col("_n") == needed)
        .select(F.timestamp_micros("_at").alias("at"))
    )


def high_error_rate(
    log: DataFrame, threshold: float = ERROR_RATIO, hold_s: int = ERROR_HOLD_S
) -> DataFrame:
    points = M.at_points(
        log, 300, STEP_S, {"n": M.count_amount(), "errors": M.error_amount()}
    )
    return held(points, F.col("errors") / F.col("n") > threshold, hold_s)


def high_p95(
    log: DataFrame, threshold: float = P95_SECONDS, hold_s: int = P95_HOLD_S
) -> DataFrame:
    points = M.latency_points(log, 300, STEP_S)
    return held(points, H.quantile(F.col("counts"), 0.95) > threshold, hold_s)


def violation_spike(
    violations: DataFrame, threshold: float = VIOLATION_RATE, hold_s: int = VIOLATION_HOLD_S
) -> DataFrame:
    return held(M.request_rate(violations, 300, STEP_S), F.col("rate") > threshold, hold_s)


def reflection_seen(
    reflections: DataFrame,
    window_s: int = REFLECTION_WINDOW_S,
    hold_s: int = REFLECTION_HOLD_S,
) -> DataFrame:
    points = M.increase(reflections, window_s, STEP_S)
    return held(points, F.col("value") > 0, hold_s)


def absent(
    log: DataFrame, target: str, hold_s: int = ABSENT_HOLD_S, slice_s: int = 86_400,
    until: datetime | None = None,
) -> DataFrame:
    """Outages per target: steps without a request for longer than the hold time.

    Returns the last step with a request, when the alert starts to fire, and the step in
    which requests came back. A target that is silent at the evaluation time ``until`` (by
    default the last moment of the whole log) is still out: ``seen_again`` is null.
    """
    step = STEP_S * MICROS

    def on_grid(moment: Column) -> Column:
        return F.ceil(F.unix_micros(moment) / F.lit(step)) * F.lit(step)

    seen = log.select(F.col(target).alias("target"), on_grid(F.col("ts")).alias("_at")).distinct()
    sliced = seen.withColumn("_slice", F.floor(F.col("_at") / F.lit(slice_s * MICROS)))
    stepped = previous_value(sliced, ["target"], "_slice", ["_at"], "_at", "_last")
    closed = stepped.select("target", "_last", F.col("_at").alias("_again"))
    end = until or log.agg(F.max("ts")).first()[0]
    last = seen.groupBy("target").agg(F.max("_at").alias("_last")).select(
        "target", "_last", F.lit(None).cast("bigint").alias("_again"))
    firing = F.col("_last") + F.lit(step + hold_s * MICROS)
    still = last.where(firing < on_grid(F.lit(end).cast("timestamp")))
    return closed.where(firing < F.col("_again")).unionByName(still).select(
        "target",
        F.timestamp_micros("_last").alias("last_seen"),
        F.timestamp_micros(firing).alias("firing_from"),
        F.timestamp_micros("_again").alias("seen_again"),
    )
