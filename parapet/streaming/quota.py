"""Sliding quotas over a stream of requests.

Two forms share the columns of ``operators.admission.decide``:

* ``QuotaStream`` judges every micro-batch with the batch operator, next to the requests
  of the last window, which it keeps in a table. A busy key is cut into time slices there
  and spreads over many tasks.
* ``stateful_quota`` keeps the window of each key in Spark's keyed state. Its latency is
  lower, but a key stays in one task; use it where no key dominates.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parapet.operators.admission import MICROS, QuotaPolicy, quota_key, rate_limit
from parapet.sources.tables import exists


class QuotaStream:
    """State of a quota over micro-batches: a table of the requests of the last window.

    Every batch writes its own copy of that table and reads only the one before it, so the
    work per batch follows the batch and the window, not the age of the stream. ``advance``
    may run again for the same batch after a failure and replaces what the first attempt
    wrote. Micro-batches have consecutive numbers from 0; tables more than one batch old are
    not read again. A request that is older than the newest one of the batches before
    cannot be judged in order: it goes to the table of late requests (``late``), which
    ``rate_limit`` judges together with the whole log.
    """

    def __init__(self, spark: SparkSession, policy: QuotaPolicy, folder: str) -> None:
        self._spark = spark
        self._policy = policy
        self._folder = folder

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self._folder}/{table}/batch={batch_id}"

    def _kept(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        path = self._path(table, batch_id)
        df.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        log = self._kept(
            batch.select(
                "request_id", "ts", quota_key(F.col("api_key")).alias("api_key"),
                F.lit(True).alias("fresh"),
            ),
            "requests", batch_id,
        )
        if batch_id > 0:
            recent = self._spark.read.schema(log.schema).parquet(self._path("recent", batch_id - 1))
            newest = recent.agg(F.max("ts")).first()[0]
            if newest is not None:
                self._kept(log.where(F.col("ts") < F.lit(newest)).drop("fresh"), "late", batch_id)
                log = log.where((F.col("ts") >= F.lit(newest)) | F.col("ts").isNull())
            log = log.unionByName(recent)
        decided = rate_limit(log, self._policy).where("fresh").drop("fresh")
        self._kept(decided, "decisions", batch_id)
        # One row: the earliest moment that a window of the next batch can reach back to.
        window = F.lit(self._policy.window_seconds * MICROS)
        reach = log.agg((F.max(F.unix_micros("ts")) - window).alias("lo")).select("lo").scalar()
        still_needed = log.where(F.unix_micros("ts") >= reach).withColumn("fresh", F.lit(False))
        self._kept(still_needed, "recent", batch_id)

    def late(self) -> DataFrame:
        """Requests that came too late for a decision, with the batch that brought them."""
        if not exists(self._spark, f"{self._folder}/late"):
            return self._spark.createDataFrame(
                [], "request_id long, ts timestamp, api_key string, batch int")
        return self._spark.read.parquet(f"{self._folder}/late")

    def decisions(self) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/decisions").drop("batch")


def late_requests(log: DataFrame, judged: DataFrame) -> DataFrame:
    """The requests of a whole log that a stream gave no decision."""
    return log.join(judged.select("request_id"), "request_id", "left_anti")


DECISION_SCHEMA = (
    "request_id long, api_key string, ts timestamp, window_count long, allowed boolean, "
    "remaining long, reset_at timestamp, retry_after double"
)


def stateful_quota(
    log: DataFrame, policy: QuotaPolicy, lateness: str = "1 hour"
) -> DataFrame:
    """Decisions in update mode from keyed state that holds the times of the last window.

    The state of a key is dropped once the watermark is a whole window past its last
    request. A request that arrives after newer ones, but within ``lateness``, is counted
    among the requests before it; the later decisions stand. Requests later than
    ``lateness`` are not judged here: ``late_requests`` keeps them for the batch operator.
    """
    window_us = policy.window_seconds * MICROS
    late_us = int(pd.Timedelta(lateness).total_seconds()) * MICROS

    def judge(
        key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        # Most keys bring a few rows: arrays cost a fraction of what frames would.
        parts = [(f["request_id"].to_numpy(), f["ts"].to_numpy()) for f in frames]
        ids, ts = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((ids, ts))  # rows without a time come last
        ids, ts = ids[order], ts[order]
        micros = ts.astype("datetime64[us]").astype(np.int64)
        moments = micros.tolist()
        counts, starts = [], []
        for now in moments:
            last = bisect_right(times, now)
            times.insert(last, now)
            first = bisect_left(times, now - window_us)
            counts.append(last + 1 - first)
            starts.append(times[first])
        # a request may still come lateness behind the newest one and look a window back
        kept = times[bisect_left(times, times[-1] - window_us - late_us):]
        state.update((kept,))
        state.setTimeoutTimestamp((times[-1] + window_us + late_us) // 1000 + 1)
        count = np.array(counts, np.int64)
        reset = np.array(starts, np.int64) + window_us
        allowed = count <= policy.limit
        yield pd.DataFrame({
            "request_id": ids, "api_key": key[0], "ts": ts, "window_count": count, "allowed": allowed,
            "remaining": np.maximum(policy.limit - count, 0),
            "reset_at": reset.astype("datetime64[us]"),
            "retry_after": np.where(allowed, np.nan, np.maximum(reset - micros, 0) / MICROS),
        })

    keyed = log.withWatermark("ts", lateness).select(
        quota_key(F.col("api_key")).alias("api_key"), "request_id", "ts"
    )
    return keyed.groupBy("api_key").applyInPandasWithState(
        judge, DECISION_SCHEMA, "times array<long>", "update",
        GroupStateTimeout.EventTimeTimeout,
    )
