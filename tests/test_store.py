import pytest
from pyspark.sql import functions as F

from parapet.operators import store as S
from parapet.session import shared_folder

SCHEMA = "chunk_id string, content string, version long"


def test_upsert_and_delete(spark):
    held = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], SCHEMA)
    batch = spark.createDataFrame([("b", "2", 2), ("b", "3", 3), ("c", "2", 2)], SCHEMA)
    merged = S.upsert(held, batch, ["version"])
    want = {("a", "1"), ("b", "3"), ("c", "2")}
    assert {(r.chunk_id, r.content) for r in merged.collect()} == want
    again = S.upsert(merged, batch, ["version"])
    assert {(r.chunk_id, r.content) for r in again.collect()} == want
    assert {r.chunk_id for r in S.delete_ids(merged, ["b", "zz"]).collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        S.delete_ids(merged, [])
    with pytest.raises(ValueError):
        S.delete_ids(merged, ["x"] * 501)
    ids = spark.createDataFrame([("a",), ("zz",)], "chunk_id string")
    report = S.delete_report(merged, ids).first()
    assert (report["count"], report.rows_deleted) == (2, 1)


def test_table_on_disk(spark):
    path = shared_folder(spark, "store-test")
    rows = "chunk_id string, content string, collection string"
    S.write_batch(spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], rows), path, 0)
    S.write_batch(spark.createDataFrame([("a", "2", "x")], rows), path, 1)
    S.write_batch(spark.createDataFrame([("a", "3", "x")], rows), path, 1)
    got = {(r.chunk_id, r.content) for r in S.read_current(spark, path).collect()}
    assert got == {("a", "3"), ("b", "1")}
    assert S.read_current(spark, path, "y").count() == 1
    S.compact(spark, path, f"{path}-compact")
    assert S.read_current(spark, f"{path}-compact").count() == 2


def test_deletes_and_replacements_on_the_written_table(spark):
    path = shared_folder(spark, "store-deletes")
    rows = "chunk_id string, content string, collection string"
    S.write_batch(spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "y")], rows), path, 0)
    S.delete_batch(spark.createDataFrame([("a",), ("b",), ("zz",), ("b",), (None,)], "chunk_id string"), path, 1)
    S.write_batch(spark.createDataFrame([("b", "2", "x"), ("c", "2", "y")], rows), path, 2)
    want = {("b", "2"), ("c", "2")}
    assert {(r.chunk_id, r.content) for r in S.read_current(spark, path).collect()} == want
    S.compact(spark, path, f"{path}-compact")
    assert {(r.chunk_id, r.content) for r in S.read_current(spark, f"{path}-compact").collect()} == want


def test_a_batch_that_runs_again_replaces_all_its_collections(spark):
    path = shared_folder(spark, "store-retry")
    rows = "chunk_id string, content string, collection string"
    S.write_batch(spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], rows), path, 0)
    S.write_batch(spark.createDataFrame([("a", "2", "x")], rows), path, 0)
    assert [tuple(r) for r in S.read_current(spark, path).select("chunk_id", "content").collect()] == [("a", "2")]


def test_listing(spark):
    df = spark.createDataFrame(
        [(f"id{i:03d}", "c" * 200, {"source": "s"} if i % 2 else {}) for i in range(30)],
        "chunk_id string, content string, metadata map<string,string>",
    )
    page = S.listing(df, 3, 1).collect()
    assert [r.id for r in page] == ["id001", "id002", "id003"]
    assert [r.id for r in S.listing(df, 3, after="id000").collect()] == ["id001", "id002", "id003"]
    assert page[1].source == "unknown" and page[1].chunk_index == "0"
    assert len(page[0].content_preview) == 120
    with pytest.raises(ValueError):
        S.listing(df, 101)


def test_summary_counts_copies(spark):
    chunks = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "c")],
                                   "source string, chunk_id string")
    held = spark.createDataFrame([("b",), ("c",)], "chunk_id string")
    sources = spark.createDataFrame([("s",), ("t",), ("u",)], "source string")
    got = {r.source: r for r in S.ingest_summary(chunks, held, sources).collect()}
    assert (got["s"].chunks_created, got["s"].duplicates_skipped) == (2, 1)
    assert (got["t"].chunks_created, got["t"].duplicates_skipped) == (0, 1)
    assert got["u"].warnings and not got["s"].warnings


def test_collections_are_namespaces(spark):
    path = shared_folder(spark, "store-namespaces")
    rows = "chunk_id string, content string, collection string"
    S.write_batch(spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), ("b", "2", "y")], rows), path, 0)
    S.delete_batch(spark.createDataFrame([("b",)], "chunk_id string"), path, 1, "x")
    S.write_batch(spark.createDataFrame([("a", "3", "x")], rows), path, 2)
    want = {("x", "a", "3"), ("y", "a", "2"), ("y", "b", "2")}
    read = lambda p, c=None: {
        (r.collection, r.chunk_id, r.content) for r in S.read_current(spark, p, c).collect()}
    assert read(path) == want and read(path, "x") == {("x", "a", "3")}
    S.compact(spark, path, f"{path}-compact")
    assert read(f"{path}-compact") == want and read(f"{path}-compact", "y") == {("y", "a", "2"), ("y", "b", "2")}
    assert {(r.collection, r.chunk_id) for r in S.read_current(spark, path, before=1).collect()} == {
        ("x", "a"), ("y", "a"), ("x", "b"), ("y", "b")}


def test_lookup_reads_the_buckets_of_its_ids(spark):
    path = shared_folder(spark, "store-buckets")
    ids = [f"{i:032x}" for i in range(400)]
    rows = spark.createDataFrame([(i, "t", "documents") for i in ids], "chunk_id string, content string, collection string")
    S.write_batch(rows, path, 0)
    asked = spark.createDataFrame([(ids[7],), ("new",)], "chunk_id string")
    held = S.held_ids(spark, path, asked)
    assert S.existing_ids(held, asked).count() == 1
    assert 0 < held.count() < 100  # one or two of sixteen buckets
    assert "bucket#" in held._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert S.held_ids(spark, f"{path}-none", asked).count() == 0


def test_deleted_text_comes_back(spark):
    from parapet.operators import intake
    from parapet.streaming.ingest import IngestStream
    from pyspark.sql import functions as F

    job = IngestStream(spark, shared_folder(spark, "ingest-back"))
    files = intake.file_rows(
        spark.createDataFrame([("a.txt", "Some words that are kept."), ("b.txt", "Other words.")], "n string, t string"),
        F.col("n"), F.encode("t", "UTF-8"), F.lit(None).cast("string"))
    job.advance(files, 0)
    job.delete(job.chunks().where("content like 'Some%'").select("chunk_id"), 0)
    assert job.chunks().count() == 1
    for _ in range(2):  # a micro-batch that runs again says the same
        job.advance(files, 1)
        got = {r.source: (r.chunks_created, r.duplicates_skipped) for r in job.summaries().where("batch = 1").collect()}
        assert got == {"a.txt": (1, 0), "b.txt": (0, 1)}
    assert job.chunks().count() == 2


def test_the_same_file_twice_is_two_uploads(spark):
    from parapet.operators import intake
    from parapet.plans.ingest import ingest
    from pyspark.sql import functions as F

    files = intake.file_rows(
        spark.createDataFrame([("a.txt", "Some words.", 1), ("a.txt", "Some words.", 2)], "n string, t string, u long"),
        F.col("n"), F.encode("t", "UTF-8"), F.lit(None).cast("string"))
    numbered = files.withColumn("upload_id", F.monotonically_increasing_id())
    _, summary, _ = ingest(numbered, spark.createDataFrame([], "chunk_id string"))
    assert summary.count() == 2


def test_a_reader_of_ids_reads_no_texts(spark):
    path = shared_folder(spark, "ids-only")
    rows = spark.createDataFrame([("a", "x", "c"), ("b", "y", "c")], "chunk_id string, content string, collection string")
    S.write_batch(rows, path, 0)
    S.write_batch(rows.where("chunk_id = 'a'").withColumn("content", F.lit("z")), path, 1)
    S.delete_batch(rows.where("chunk_id = 'b'"), path, 1)
    current = S.read_current(spark, path)
    assert [(r.chunk_id, r.content) for r in current.collect()] == [("a", "z")]
    plan = current.select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "chunk_id" in plan and "content" not in plan
