"""The whole way of a request to its route: keys first, then quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parapet.operators.admission import QuotaPolicy, authenticate, is_public, rate_limit

FORBIDDEN = 403
TOO_MANY = 429


def admit(log: DataFrame, keys: DataFrame, policy: QuotaPolicy) -> DataFrame:
    """Add ``admission_status``: 403, 429, or the status of the route itself.

    Public paths skip both checks. Only authenticated requests use up quota.
    """
    judged = authenticate(log, keys).withColumn("public", is_public(F.col("path")))
    metered = judged.where(F.col("authenticated") & ~F.col("public"))
    decided = rate_limit(metered.select("request_id", "ts", "api_key"), policy).select(
        "request_id", "allowed"
    )
    return judged.join(decided, "request_id", "left").withColumn(
        "admission_status",
        F.when(F.col("public"), F.col("status"))
        .when(~F.col("authenticated"), FORBIDDEN)
        .when(~F.col("allowed"), TOO_MANY)
        .otherwise(F.col("status")),
    )
