"""Windowed request rates over a stream, with a bound on lateness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.sources.tables import exists


def stream_rate(
    log: DataFrame, length_s: int = 60, lateness: str = "10 minutes", by: Sequence[str] = ()
) -> DataFrame:
    """Requests per second in tumbling windows ``[window_start, window_start + length)``.

    In append mode a window is written once, when the watermark has passed its end; rows
    that come later than ``lateness`` are dropped, and Spark reports their number.
    """
    window = F.window("ts", f"{length_s} seconds")
    return (
        log.withWatermark("ts", lateness).groupBy(window, *by).agg(F.count("*").alias("n"))
        .select(
            F.col("window.start").alias("window_start"), *by, "n",
            (F.col("n") / length_s).alias("rate"),
        )
    )


class RateStream:
    """Tumbling counts of a stream that lose no row: used with ``foreachBatch``.

    A micro-batch is compared with the largest time of the batches before it, less
    ``lateness_s``. Rows whose window had closed by then, and rows without a time, are split off
    into the table of late rows, with a reason; all others are counted. Every batch writes its
    own part of both tables, so one that runs again replaces itself. Rows in are rows counted
    plus late rows, and ``judged`` counts both, as the batch operator would.
    """

    def __init__(self, spark: SparkSession, folder: str, length_s: int = 60, lateness_s: int = 600,
                 by: Sequence[str] = ()) -> None:
        self._spark, self._counts, self._late = spark, f"{folder}/counts", f"{folder}/late"
        self._length_s, self._lateness_s, self._by = length_s, lateness_s, tuple(by)

    def _mark_us(self, before: int) -> int | None:
        """The time up to which windows are closed for a batch: one number from all earlier ones."""
        if not exists(self._spark, self._counts):
            return None
        earlier = self._spark.read.parquet(self._counts).where(F.col("batch") < before)
        last = earlier.agg(F.max("last_us")).first()[0]
        return None if last is None else last - self._lateness_s * 1_000_000

    def _windowed(self, log: DataFrame) -> DataFrame:
        length_us = self._length_s * 1_000_000
        return log.withColumn("_at_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
            "window_start_us", F.floor(F.col("_at_us") / length_us) * length_us)

    def _counted(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("window_start_us", *self._by).agg(
            F.count("*").alias("n"), F.max("_at_us").alias("last_us"))

    def advance(self, log: DataFrame, batch_id: int) -> None:
        mark = self._mark_us(batch_id)
        rows = self._windowed(log)
        closed = F.lit(False) if mark is None else (
            F.col("window_start_us") + self._length_s * 1_000_000 <= F.lit(mark))
        reason = F.when(F.col("_at_us").isNull(), "no_time").when(closed, "late")
        judged = rows.withColumn("reason", reason)
        self._counted(judged.where(F.col("reason").isNull())).write.mode("overwrite").parquet(
            f"{self._counts}/batch={batch_id}")
        judged.where(F.col("reason").isNotNull()).drop("_at_us", "window_start_us").write.mode(
            "overwrite").parquet(f"{self._late}/batch={batch_id}")

    def counts(self) -> DataFrame:
        """``batch`` and the counts that it added."""
        return self._spark.read.parquet(self._counts)

    def late(self) -> DataFrame:
        """The rows that were split off, with ``reason`` and ``batch``."""
        return self._spark.read.parquet(self._late)

    def _rates(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("window_start_us", *self._by).agg(F.sum("n").alias("n")).withColumn(
            "rate", F.col("n") / self._length_s)

    def rates(self) -> DataFrame:
        """Counts and rates per window from the rows that came in time."""
        return self._rates(self.counts())

    def judged(self) -> DataFrame:
        """Counts and rates per window with the late rows."""
        again = self._counted(self._windowed(self.late().where(F.col("ts").isNotNull())))
        columns = ["window_start_us", *self._by, "n"]
        return self._rates(self.counts().select(*columns).unionByName(again.select(*columns)))


def stream_unique(chunks: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop chunks whose id came already within the watermark."""
    return chunks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["chunk_id"])
