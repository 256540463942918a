from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parapet.operators.admission import QuotaPolicy, rate_limit
from parapet.plans.q_streaming import stream_ingest, table_stream
from parapet.session import shared_folder
from parapet.sources.access_log import read_access_log, stream_access_log
from parapet.streaming.ingest import IngestStream
from parapet.streaming.quota import QuotaStream
from parapet.streaming.rates import stream_unique

START = datetime(2024, 1, 1)


def test_quota_over_batches_equals_one_batch(spark):
    policy = QuotaPolicy(3, 60, 1)
    rows = [(i, START + timedelta(seconds=7 * i), "ab"[i % 5 == 0]) for i in range(60)]
    log = spark.createDataFrame(rows, "request_id long, ts timestamp, api_key string")
    stream = QuotaStream(spark, policy, shared_folder(spark, "quota-test"))
    for batch in range(4):
        part = log.where(F.floor(F.col("request_id") / 15) == batch)
        stream.advance(part, batch)
        if batch == 2:
            stream.advance(part, batch)  # a retry after a failure
    columns = ["request_id", "window_count", "allowed", "reset_at", "retry_after"]
    got = {tuple(r) for r in stream.decisions().select(*columns).collect()}
    want = {tuple(r) for r in rate_limit(log, policy).select(*columns).collect()}
    assert got == want


def test_late_requests_are_kept_aside(spark):
    schema = "request_id long, ts timestamp, api_key string"
    stream = QuotaStream(spark, QuotaPolicy(3, 60, 1), shared_folder(spark, "quota-late"))
    assert stream.late().count() == 0
    stream.advance(spark.createDataFrame([(1, START, "a"), (2, START + timedelta(seconds=50), "a")], schema), 0)
    stream.advance(spark.createDataFrame(
        [(3, START + timedelta(seconds=20), "a"), (4, START + timedelta(seconds=55), "a")], schema), 1)
    assert [r.request_id for r in stream.late().collect()] == [3]
    assert {r.request_id: r.window_count for r in stream.decisions().collect()} == {1: 1, 2: 2, 4: 3}


def test_a_key_with_nine_tenths_of_all_requests(spark):
    policy = QuotaPolicy(5, 30)
    rows = [(i, START + timedelta(seconds=i), "hot" if i % 10 else f"k{i}") for i in range(400)]
    log = spark.createDataFrame(rows, "request_id long, ts timestamp, api_key string")
    stream = QuotaStream(spark, policy, shared_folder(spark, "quota-hot"))
    for batch in range(4):
        stream.advance(log.where(F.floor(F.col("request_id") / 100) == batch), batch)
    got = {r.request_id: r.window_count for r in stream.decisions().collect()}
    want = {i: sum(k == key and t - timedelta(seconds=30) <= u <= t for _, u, k in rows) for i, t, key in rows}
    assert got == want


def test_ingest_over_batches(spark):
    files = spark.createDataFrame(
        [("a.txt", bytearray(b"A text that is ingested. " * 30)), ("b.txt", bytearray(b"Other text. " * 20))],
        "filename string, content binary",
    ).select("filename", "content", F.octet_length("content").cast("long").alias("length"),
             F.lit(None).cast("string").alias("declared_mime"))
    job = IngestStream(spark, shared_folder(spark, "ingest-test"))
    job.advance(files.where("filename = 'a.txt'"), 0)
    job.advance(files, 1)
    job.advance(files, 1)
    got = {(r.batch, r.source): (r.chunks_created, r.duplicates_skipped)
           for r in job.summaries().collect()}
    made = got[0, "a.txt"][0]
    assert got == {(0, "a.txt"): (made, 0), (1, "a.txt"): (0, made), (1, "b.txt"): (1, 0)}
    assert job.chunks().count() == made + 1


def test_access_log_source_and_stream_dedup(spark, tmp_path):
    (tmp_path / "log.json").write_text(
        '{"timestamp": "2024-01-01T00:00:00Z", "method": "GET", "path": "/x", "status": 200,'
        ' "duration_ms": 1.5, "client_ip": "unknown", "request_id": "r1"}\nnot json\n')
    rows = read_access_log(spark, str(tmp_path)).where("method is not null").collect()
    assert len(rows) == 1 and rows[0].status == 200 and rows[0].duration_ms == 1.5
    stream = stream_access_log(spark, str(tmp_path))
    assert stream.isStreaming
    unique = stream_unique(stream.select(F.col("timestamp").alias("ts"), F.col("request_id").alias("chunk_id")))
    assert unique.isStreaming


def test_late_rows_are_split_off_and_judged(spark):
    from parapet.streaming.rates import RateStream

    folder = shared_folder(spark, "rate-test")
    job = RateStream(spark, folder, 60, 120, ["key"])
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batch = lambda rows: spark.createDataFrame([(at(s) if s is not None else None, k) for s, k in rows],
                                               "ts string, key string").selectExpr("cast(ts AS timestamp) AS ts", "key")
    first, second = batch([(10, "a"), (300, "a"), (None, "b")]), batch([(20, "a"), (150, "b"), (180, "a"), (310, "a")])
    job.advance(first, 0)
    for _ in range(2):  # closed up to 180 s: the windows that end at 60 and 180 are, that at 180 is open
        job.advance(second, 1)
    got = {(r.window_start_us // 10**6 % 3600, r.key): r.n for r in job.rates().collect()}
    assert got == {(0, "a"): 1, (300, "a"): 2, (180, "a"): 1}
    assert sorted((r.reason, r.key, r.batch) for r in job.late().collect()) == [
        ("late", "a", 1), ("late", "b", 1), ("no_time", "b", 0)]
    judged = {(r.window_start_us // 10**6 % 3600, r.key): r.n for r in job.judged().collect()}
    assert judged == {**got, (0, "a"): 2, (120, "b"): 1}


@pytest.mark.parametrize("parts", [None, 3])
def test_a_table_is_streamed_as_a_file_or_as_a_folder(spark, tmp_path, parts):
    docs = spark.createDataFrame([(i, f"Text number {i} of a document. " * 9) for i in range(7)], "doc_id long, text string")
    path = tmp_path / "documents.parquet"
    if parts:
        docs.repartition(parts).write.parquet(str(path))
    else:
        docs.toPandas().to_parquet(path)
    assert table_stream(spark, str(tmp_path), "documents").isStreaming
    rows = stream_ingest(spark, str(tmp_path)).collect()
    assert sorted(r.source for r in rows) == [f"{i}.txt" for i in range(7)]
