"""The chunk table: upsert, delete, lookup, listing, collections, duplicates.

A table is a folder of parquet files partitioned by batch, collection and a bucket of the
id. Collections are namespaces: a row's key is its collection and its id. Writing a batch
again replaces that batch as a whole, so a retried job leaves the table as it was meant to
be. Deletes are batches of ids beside the table, for one collection or for all:
``read_current`` and ``compact`` leave out every row that is older than a delete of its key.
Batch numbers order writes and deletes, and the table can be read as it stood before a
batch. A lookup of ids reads the buckets of these ids only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parapet.functions import text as T
from parapet.sources.tables import exists

BULK_DELETE_LIMIT = 500
DEFAULT_COLLECTION = "documents"
BUCKETS = 16


def one_per_id(df: DataFrame, order: Sequence[str], latest: bool = True,
               key: str | Sequence[str] = "chunk_id") -> DataFrame:
    """Keep the last (or first) row per id, or per combination of several columns.

    An aggregate, not a ranking window: copies are reduced on the map side first, so a
    group of copies of any size reaches the reducer as one row per input partition.
    """
    pick = F.max_by if latest else F.min_by
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(store: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """The store with the batch written over it; inside the batch the last row wins."""
    newest = one_per_id(batch, order)
    kept = store.join(newest.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(newest)


def delete_ids(store: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Remove up to 500 listed ids; ids that are not there change nothing."""
    if not ids:
        raise ValueError("ids list is empty")
    if len(ids) > BULK_DELETE_LIMIT:
        raise ValueError(f"bulk delete is limited to {BULK_DELETE_LIMIT} ids")
    return store.where(~F.col("chunk_id").isin(list(ids)))


def delete_matching(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove every id of a table of ids, whatever its size."""
    return store.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def delete_report(store: DataFrame, ids: DataFrame) -> DataFrame:
    """``count`` is the size of the request; ``rows_deleted`` what it removed."""
    wanted = ids.groupBy("chunk_id").agg(F.count("*").alias("n"))
    held = store.groupBy("chunk_id").agg(F.count("*").alias("rows"))
    return wanted.join(held, "chunk_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_deleted"),
    )


def existing_ids(store: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate ids that the store already holds, each once."""
    return candidates.select("chunk_id").distinct().join(
        store.select("chunk_id"), "chunk_id", "left_semi"
    )


def new_chunks(store: DataFrame, chunks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Chunks whose id the store does not hold, one row per id."""
    return one_per_id(chunks, order, latest=False).join(
        store.select("chunk_id"), "chunk_id", "left_anti"
    )


def listing(
    store: DataFrame, limit: int = 20, offset: int = 0, after: str | None = None
) -> DataFrame:
    """One page of the table in id order, with defaults and a 120-character preview.

    ``after`` is the last id of the page before: the page is then the smallest ids beyond
    it, which costs the same however deep it lies. ``offset`` counts from the first id.
    """
    if after is not None:
        store = store.where(F.col("chunk_id") > after)
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must lie in 1..100 and offset must not be negative")
    meta = F.col("metadata")
    return (
        store.orderBy("chunk_id").offset(offset).limit(limit)
        .select(
            F.col("chunk_id").alias("id"),
            F.coalesce(meta["source"], F.lit("unknown")).alias("source"),
            F.coalesce(meta["chunk_index"], F.lit("0")).alias("chunk_index"),
            meta["page"].alias("page"),
            meta["section"].alias("section"),
            T.preview(F.col("content"), 120).alias("content_preview"),
        )
    )


def collection_name(requested: Column, default: str = DEFAULT_COLLECTION) -> Column:
    return F.coalesce(F.nullif(requested, F.lit("")), F.lit(default))


def ingest_summary(
    chunks: DataFrame, store: DataFrame, sources: DataFrame, collection: str = DEFAULT_COLLECTION
) -> DataFrame:
    """Per upload: chunks created, duplicates skipped, warning, collection.

    An upload is a row of ``sources``: its ``upload_id`` and ``source``, or the source alone
    where there is no id. Copies inside the batch are counted before the join, so the join
    sees unique ids.
    """
    keys = [k for k in ("upload_id", "source") if k in sources.columns]
    counted = chunks.groupBy(*keys, "chunk_id").agg(F.count("*").alias("n"))
    known = store.select("chunk_id").distinct().withColumn("known", F.lit(True))
    per_source = (
        counted.join(known, "chunk_id", "left")
        .groupBy(*keys)
        .agg(
            F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("created"),
            F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("skipped"),
        )
    )
    created = F.coalesce("created", F.lit(0))
    skipped = F.coalesce("skipped", F.lit(0))
    return (
        sources.select(*keys).distinct().join(per_source, keys, "left")
        .select(
            *keys,
            created.alias("chunks_created"),
            skipped.alias("duplicates_skipped"),
            F.when(
                created + skipped == 0,
                F.array(F.lit("No chunks produced — file may be empty or unreadable.")),
            ).otherwise(F.array().cast("array<string>")).alias("warnings"),
            F.lit(collection).alias("collection"),
        )
    )


def id_bucket(chunk_id: Column) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(BUCKETS)).cast("int")


def write_batch(chunks: DataFrame, path: str, batch_id: int) -> None:
    """Add or replace one batch of the table at ``path``; a row replaces rows of its
    collection and id in earlier batches."""
    (
        chunks.withColumn("bucket", id_bucket(F.col("chunk_id")))
        .write.mode("overwrite").partitionBy("collection", "bucket").parquet(f"{path}/batch={batch_id}")
    )


def _deleted_folder(path: str) -> str:
    return f"{path.rstrip('/')}-deleted"


def delete_batch(ids: DataFrame, path: str, batch_id: int, collection: str | None = None) -> None:
    """Delete the ids from the table as of ``batch_id``: from the named collection, from that
    in the ids' own ``collection`` column, or, where that is null or missing, from all. An id
    that is not there, or comes twice, changes nothing. Running the batch again replaces it."""
    place = F.lit(collection) if collection is not None or "collection" not in ids.columns else F.col("collection")
    (
        ids.select("chunk_id", place.cast("string").alias("collection")).where(F.col("chunk_id").isNotNull())
        .distinct().write.mode("overwrite").parquet(f"{_deleted_folder(path)}/batch={batch_id}")
    )


def read_current(
    spark: SparkSession, path: str, collection: str | None = None, before: int | None = None,
    buckets: Sequence[int] | None = None,
) -> DataFrame:
    """The table as it stands: per collection and id the row of the last batch, without
    deleted ones. Reads one collection, the batches before one, some buckets, if named."""
    rows = spark.read.parquet(path).withColumn("collection", F.col("collection").cast("string"))
    if collection is not None:
        rows = rows.where(F.col("collection") == collection)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(list(buckets)))
    # One aggregate per column, so that a reader of ids neither reads nor shuffles texts.
    keys = ["collection", "chunk_id"]
    current = rows.groupBy(*keys).agg(
        *[F.max_by(c, "batch").alias(c) for c in rows.columns if c not in (*keys, "batch", "bucket")],
        F.max("batch").alias("batch"))
    if exists(spark, _deleted_folder(path)):
        deletes = spark.read.parquet(_deleted_folder(path))
        if before is not None:
            deletes = deletes.where(F.col("batch") < before)
        if buckets is not None:
            deletes = deletes.where(id_bucket(F.col("chunk_id")).isin(list(buckets)))
        gone = deletes.groupBy("chunk_id", "collection").agg(F.max("batch").alias("_gone"))
        everywhere = gone.where(F.col("collection").isNull()).select("chunk_id", F.col("_gone").alias("_all"))
        own = gone.where(F.col("collection").isNotNull())
        last = F.greatest("_gone", "_all")
        current = current.join(everywhere, "chunk_id", "left").join(
            own, ["collection", "chunk_id"], "left").where(
            last.isNull() | (last < F.col("batch"))).drop("_gone", "_all")
    return current.select(*[c for c in rows.columns if c not in ("batch", "bucket")])


def held_ids(
    spark: SparkSession, path: str, candidates: DataFrame, collection: str = DEFAULT_COLLECTION,
    before: int | None = None,
) -> DataFrame:
    """``chunk_id`` of the rows that the collection holds, before a batch if named, in the
    buckets of the candidates; a table that is not there yet holds nothing."""
    if not exists(spark, path):
        return candidates.select("chunk_id").limit(0)
    buckets = [r[0] for r in candidates.select(id_bucket(F.col("chunk_id"))).distinct().collect()]
    return read_current(spark, path, collection, before, buckets).select("chunk_id")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current state to a new folder as one batch; deletes are applied for good."""
    write_batch(read_current(spark, path), target, 0)
