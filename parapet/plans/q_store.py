"""Queries over sources, sinks and the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.functions import text as T
from parapet.operators import intake, metrics, store
from parapet.plans import derived as D
from parapet.session import shared_folder
from parapet.sources.access_log import event_props, log_lines, read_access_log
from parapet.sources.tables import table, text_table


def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = intake.file_rows(
        D.raw_files(spark, sf), F.col("name"), F.col("content"), F.lit("text/plain")
    )
    return rows.select("filename", "length", "declared_mime")


def size_guard(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents", "doc_id", "text")
    rows = intake.file_rows(
        docs, F.col("doc_id").cast("string"), F.encode("text", "UTF-8"),
        F.lit(None).cast("string"),
    )
    return intake.guard_size(rows, 8192).select("filename", "length", "reason")


def _versioned(rows: DataFrame, version: int) -> DataFrame:
    return rows.select(
        T.position_id(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")),
                      F.col("chunk_index")).alias("chunk_id"),
        "source", "content", F.lit(version).cast("long").alias("version"),
    )


def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are stored; then pages arrive, and all documents again in capitals."""
    docs = D.doc_chunks(spark, sf)
    held = _versioned(docs, 1)
    batch = _versioned(D.page_chunks(spark, sf), 2).unionByName(
        _versioned(docs.withColumn("content", F.upper("source")), 2)
    )
    return store.upsert(held, batch, ["version"]).groupBy("source", "version").agg(
        F.count("*").alias("rows"), F.sum(F.length("content")).alias("chars"),
        F.min("chunk_id").alias("first_id"),
    )


def _toxic_ids(spark: SparkSession, sf: str) -> DataFrame:
    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    return D.doc_chunks(spark, sf).join(toxic, "doc_id", "left_semi").select("chunk_id")


def store_delete(spark: SparkSession, sf: str) -> DataFrame:
    held = store.one_per_id(D.doc_chunks(spark, sf), ["doc_id", "chunk_index"], latest=False)
    left = store.delete_matching(held, _toxic_ids(spark, sf))
    return left.groupBy("source").agg(
        F.count("*").alias("rows"), F.min("chunk_id").alias("first_id")
    )


def store_written(spark: SparkSession, sf: str) -> DataFrame:
    """The table on disk: documents, a delete of the toxic ones, then Spanish ones again."""
    path = shared_folder(spark, "store-written")
    docs = store.one_per_id(D.doc_chunks(spark, sf), ["doc_id", "chunk_index"], latest=False).select(
        "chunk_id", "source", "content", F.lit("documents").alias("collection"))
    store.write_batch(docs, path, 0)
    store.delete_batch(_toxic_ids(spark, sf), path, 1)
    spanish = D.doc_chunks(spark, sf).where(F.col("lang") == "es").select(
        "chunk_id", "source", F.lit("again").alias("content"), F.lit("documents").alias("collection"))
    store.write_batch(spanish.dropDuplicates(["chunk_id"]), path, 2)
    return store.read_current(spark, path).groupBy("source").agg(
        F.count("*").alias("rows"), F.sum(F.length("content")).alias("chars"), F.min("chunk_id").alias("first_id"))


def store_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    """The same ids in two collections: one loses the toxic documents, the other has its
    Spanish ones replaced; then the table is compacted."""
    path = shared_folder(spark, "store-namespaces")
    docs = store.one_per_id(D.doc_chunks(spark, sf), ["doc_id", "chunk_index"], latest=False)
    held = lambda content, place: docs.select(
        "chunk_id", "source", content.alias("content"), F.lit(place).alias("collection"))
    store.write_batch(held(F.col("content"), "documents").unionByName(held(F.col("source"), "archive")), path, 0)
    store.delete_batch(_toxic_ids(spark, sf), path, 1, "archive")
    spanish = D.doc_chunks(spark, sf).where(F.col("lang") == "es").select("chunk_id")
    store.write_batch(held(F.lit("again"), "documents").join(spanish, "chunk_id", "left_semi"), path, 2)
    store.compact(spark, path, f"{path}-compact")
    return store.read_current(spark, f"{path}-compact").groupBy("collection", "source").agg(
        F.count("*").alias("rows"), F.sum(F.length("content")).alias("chars"), F.min("chunk_id").alias("first_id"))


def delete_report(spark: SparkSession, sf: str) -> DataFrame:
    held = D.doc_chunks(spark, sf).select("chunk_id").distinct()
    asked = _toxic_ids(spark, sf).unionByName(D.page_chunks(spark, sf).select("chunk_id"))
    return store.delete_report(held, asked)


def existing_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs, pages = D.doc_chunks(spark, sf), D.page_chunks(spark, sf)
    return store.existing_ids(docs, docs.unionByName(pages))


def list_chunks(spark: SparkSession, sf: str) -> DataFrame:
    held = store.one_per_id(D.doc_chunks(spark, sf), ["doc_id", "chunk_index"], latest=False)
    described = held.withColumn(
        "metadata",
        F.map_filter(
            F.create_map(
                F.lit("source"), F.when(F.col("lang") != "es", F.col("source")),
                F.lit("chunk_index"),
                F.when(F.col("chunk_index") > 0, F.col("chunk_index").cast("string")),
            ),
            lambda _, v: v.isNotNull(),
        ),
    )
    page = store.listing(described, limit=100, offset=40)
    return page.select("id", "source", "chunk_index", "content_preview")


def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.when(F.col("lang") != "es", F.col("lang"))
    return D.doc_chunks(spark, sf).groupBy(store.collection_name(asked).alias("collection")).agg(
        F.count("*").alias("rows")
    )


def parse_event_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", event_props(F.col("props"))["k"].alias("k")
    )


def access_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as log lines, every fiftieth one broken, and read with the schema."""
    folder = shared_folder(spark, "access-log")
    log = D.requests(spark, sf)
    broken = (F.col("request_id") % 50) == 7
    log_lines(log.where(~broken)).write.text(f"{folder}/good")
    log.where(broken).select(F.concat(F.lit("broken line "), F.col("request_id").cast("string")).alias("value")
                             ).write.text(f"{folder}/broken")
    rows = read_access_log(spark, f"{folder}/*")
    return rows.select(
        "request_id", F.unix_micros("timestamp").alias("ts_us"), "method", "path",
        F.col("status").cast("long").alias("status"), "duration_ms", F.col("_corrupt_record").alias("corrupt"))


def metric_samples(spark: SparkSession, sf: str) -> DataFrame:
    log, security = D.requests(spark, sf), D.security_log(spark, sf)
    blocked = security.where("blocked")
    parts = [
        metrics.samples(
            "http_requests_total", metrics.requests_total(log), "method", "path", "status"
        ),
        metrics.samples(
            "security_violations_total",
            blocked.groupBy("threat_level").agg(F.count("*").alias("value")), "threat_level",
        ),
        metrics.samples(
            "security_rule_triggers_total",
            blocked.groupBy("rule").agg(F.count("*").alias("value")), "rule",
        ),
        metrics.samples("output_reflections_total", metrics.reflections_total(security)),
        metrics.samples(
            "rag_queries_total", security.agg(F.count_if(~F.col("blocked")).alias("value"))
        ),
    ]
    parts.append(metrics.histogram_samples(
        "http_request_duration_seconds", metrics.duration_histogram(log, "method"), "method"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.select(
        "metric", metrics.label_text(F.col("labels")).alias("labels"), F.round("value", 6).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (file_rows, size_guard, store_upsert, store_delete, store_written, store_namespaces,
              delete_report, existing_ids,
              list_chunks, collection_counts, parse_event_props, access_log, metric_samples)
}

_POSITION = "substr(sha256(source || '/' || doc_id || ':' || chunk_index), 1, 32)"
_TOXIC = """toxic AS (
  SELECT chunk_id FROM doc_chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
)"""

ORACLE = {
    "file_rows": f"""WITH {D.RAW_FILES}
SELECT filename, CAST(strlen(content) AS BIGINT) AS length, 'text/plain' AS declared_mime
FROM raw_files""",
    "size_guard": """SELECT CAST(doc_id AS VARCHAR) AS filename,
  CAST(strlen(text) AS BIGINT) AS length,
  CASE WHEN strlen(text) > 8192 THEN 'too_large' END AS reason FROM documents""",
    "store_upsert": f"""WITH {D.DOC_CHUNKS}, {D.PAGE_CHUNKS}, every AS (
  SELECT {_POSITION} AS chunk_id, source, content, 1 AS version FROM doc_chunks
  UNION ALL
  SELECT {_POSITION}, source, content, 2 FROM page_chunks
  UNION ALL
  SELECT {_POSITION}, source, upper(source), 2 FROM doc_chunks
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC) AS r FROM every
)
SELECT source, CAST(version AS BIGINT) AS version, count(*) AS rows,
       CAST(sum(length(content)) AS BIGINT) AS chars, min(chunk_id) AS first_id
FROM ranked WHERE r = 1 GROUP BY source, version""",
    "store_delete": f"""WITH {D.DOC_CHUNKS}, {_TOXIC}
SELECT source, count(DISTINCT chunk_id) AS rows, min(chunk_id) AS first_id
FROM doc_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM toxic) GROUP BY source""",
    "store_written": f"""WITH {D.DOC_CHUNKS}, {_TOXIC}, spanish AS (
  SELECT chunk_id FROM doc_chunks WHERE lang = 'es'
), held AS (
  SELECT DISTINCT chunk_id, source, CASE WHEN chunk_id IN (SELECT chunk_id FROM spanish) THEN 'again'
         ELSE content END AS content
  FROM doc_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM toxic) OR chunk_id IN (SELECT chunk_id FROM spanish)
)
SELECT source, count(*) AS rows, sum(length(content)) AS chars, min(chunk_id) AS first_id
FROM held GROUP BY source""",
    "store_namespaces": f"""WITH {D.DOC_CHUNKS}, {_TOXIC}, spanish AS (
  SELECT chunk_id FROM doc_chunks WHERE lang = 'es'
), held AS (
  SELECT DISTINCT 'documents' AS collection, chunk_id, source,
         CASE WHEN chunk_id IN (SELECT chunk_id FROM spanish) THEN 'again' ELSE content END AS content FROM doc_chunks
  UNION ALL SELECT DISTINCT 'archive', chunk_id, source, source FROM doc_chunks
  WHERE chunk_id NOT IN (SELECT chunk_id FROM toxic)
)
SELECT collection, source, count(*) AS rows, sum(length(content)) AS chars, min(chunk_id) AS first_id
FROM held GROUP BY collection, source""",
    "delete_report": f"""WITH {D.DOC_CHUNKS}, {D.PAGE_CHUNKS}, {_TOXIC}
SELECT (SELECT count(*) FROM toxic) + (SELECT count(*) FROM page_chunks) AS count,
       (SELECT count(DISTINCT chunk_id) FROM toxic) AS rows_deleted""",
    "existing_ids": f"""WITH {D.DOC_CHUNKS}, {D.PAGE_CHUNKS}, candidates AS (
  SELECT chunk_id FROM doc_chunks UNION SELECT chunk_id FROM page_chunks
)
SELECT chunk_id FROM candidates WHERE chunk_id IN (SELECT chunk_id FROM doc_chunks)""",
    "list_chunks": f"""WITH {D.DOC_CHUNKS}, held AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, chunk_index) AS r
  FROM doc_chunks
)
SELECT chunk_id AS id, CASE WHEN lang <> 'es' THEN source ELSE 'unknown' END AS source,
       CASE WHEN chunk_index > 0 THEN CAST(chunk_index AS VARCHAR) ELSE '0' END AS chunk_index,
       substr(content, 1, 120) AS content_preview
FROM held WHERE r = 1 ORDER BY chunk_id LIMIT 100 OFFSET 40""",
    "collection_counts": f"""WITH {D.DOC_CHUNKS}
SELECT coalesce(nullif(lang, 'es'), 'documents') AS collection, count(*) AS rows
FROM doc_chunks GROUP BY 1""",
    "parse_event_props": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events""",
    "metric_samples": f"""WITH {D.REQUESTS}, {D.SECURITY_LOG}, templated AS (
  SELECT method, status, CASE WHEN regexp_matches(path, '^/api/v1/documents/[^/]+$')
         THEN '/api/v1/documents/{{doc_id}}' ELSE path END AS path FROM requests
)
SELECT 'http_requests_total' AS metric,
       'method="' || method || '",path="' || path || '",status="' || status || '"' AS labels,
       CAST(count(*) AS DOUBLE) AS value FROM templated GROUP BY method, path, status
UNION ALL SELECT 'security_violations_total', 'threat_level="' || threat_level || '"',
       count(*) FROM security_log WHERE blocked GROUP BY threat_level
UNION ALL SELECT 'security_rule_triggers_total', 'rule="' || rule || '"',
       count(*) FROM security_log WHERE blocked GROUP BY rule
UNION ALL SELECT 'output_reflections_total', '', count(*) FILTER (WHERE reflection_detected)
       FROM security_log
UNION ALL SELECT 'rag_queries_total', '', count(*) FILTER (WHERE NOT blocked)
       FROM security_log
UNION ALL SELECT 'http_request_duration_seconds_bucket', 'le="' || le || '",method="' || method || '"',
       count(*) FILTER (WHERE duration_s <= bound)
       FROM requests, (VALUES ('0.01', 0.01::DOUBLE), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5),
         ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('10.0', 10.0), ('30.0', 30.0), ('+Inf', 'inf'::DOUBLE)) b(le, bound)
       GROUP BY le, method
UNION ALL SELECT 'http_request_duration_seconds_sum', 'method="' || method || '"', round(sum(duration_s), 6)
       FROM requests GROUP BY method
UNION ALL SELECT 'http_request_duration_seconds_count', 'method="' || method || '"', count(*)
       FROM requests GROUP BY method""",
    "access_log": f"""WITH {D.REQUESTS}
SELECT CASE WHEN request_id % 50 <> 7 THEN CAST(request_id AS VARCHAR) END AS request_id,
       CASE WHEN request_id % 50 <> 7 THEN epoch_us(ts) END AS ts_us,
       CASE WHEN request_id % 50 <> 7 THEN method END AS method,
       CASE WHEN request_id % 50 <> 7 THEN path END AS path,
       CASE WHEN request_id % 50 <> 7 THEN CAST(status AS BIGINT) END AS status,
       CASE WHEN request_id % 50 <> 7 THEN round(round(duration_s, 4) * 1000, 2) END AS duration_ms,
       CASE WHEN request_id % 50 = 7 THEN 'broken line ' || request_id END AS corrupt FROM requests""",
}
