"""The structured access log: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

ACCESS_LOG = StructType([
    StructField("timestamp", TimestampType()),
    StructField("level", StringType()),
    StructField("event", StringType()),
    StructField("request_id", StringType()),
    StructField("method", StringType()),
    StructField("path", StringType()),
    StructField("status", IntegerType()),
    StructField("duration_ms", DoubleType()),
    StructField("client_ip", StringType()),
])
CORRUPT = "_corrupt_record"
WITH_CORRUPT = StructType([*ACCESS_LOG.fields, StructField(CORRUPT, StringType())])
EVENT_PROPS = StructType([StructField("k", LongType())])


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines; a line that does not parse stays, whole, in ``_corrupt_record``."""
    return spark.read.schema(WITH_CORRUPT).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def stream_access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(WITH_CORRUPT).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def log_lines(log: DataFrame) -> DataFrame:
    """Requests as lines of the access log (``value``), the way the server writes them."""
    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(F.col("status") >= 500, "error").otherwise("info").alias("level"),
        F.lit("request").alias("event"), F.col("request_id").cast("string").alias("request_id"),
        "method", "path", "status", F.round(F.col("duration_s") * 1000, 2).alias("duration_ms"),
        F.col("api_key").alias("client_ip"),
    )
    return log.select(F.to_json(entry).alias("value"))


def event_props(props: Column) -> Column:
    return F.from_json(props, EVENT_PROPS)


def request_log(events: DataFrame) -> DataFrame:
    """Requests described by the event table: who asked for what, when, with which outcome."""
    k = event_props(F.col("props"))["k"]
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("api_key"),
        F.when(kind.isin("view", "click", "signup"), "GET").otherwise("POST").alias("method"),
        F.when(kind == "view", "/api/v1/documents")
        .when(kind == "click", F.concat(F.lit("/api/v1/documents/"), k.cast("string")))
        .when(kind == "signup", "/health")
        .otherwise("/api/v1/query").alias("path"),
        F.when(kind == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 100).alias("duration_s"),
    )
