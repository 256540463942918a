"""Sharding by minimax contiguous partition of atomic groups.

Equal texts are one group. Groups stand in the order of their text's SHA-256; the smallest
shard capacity for which a greedy walk needs no more than the wanted shards is found by
search, and the shards are cut where that walk cuts. No partition of this order into as
many runs of whole groups has a smaller largest shard.

The order is a hash, so running sums are taken in buckets of equal expectation: a window
inside each bucket, plus the sums of the buckets before it (at most ``MOST_BUCKETS``). The
search narrows the capacity by ``CANDIDATES`` trial capacities at a time; each greedy step
is one aggregate over the groups near the cuts. A document's shard follows from comparing
its digest with the cuts, so documents never join and texts never shuffle. Numbers inside a
shard come from counts per (shard, bucket of the id) and a window inside each.

Only column functions run on the executors.

Defined cases: a null text is an empty one; repeated rows are documents of their own in
one group and get slots of their own; a null id is an id like any other; an empty table
gives an empty table; with fewer groups than shards the last shards are empty; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parapet.llm.shared import stage

SHARDS = 8
BUCKETS, MOST_BUCKETS = 256, 1 << 16
ROWS_PER_BUCKET = 1 << 18
CANDIDATES = 64


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, digest`` without the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"))


def _bucket(digest: Column, number: int) -> Column:
    """Bucket of a digest; buckets are in digest order."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * number / (1 << 32)).cast("int")


def buckets_for(rows: int) -> int:
    return min(MOST_BUCKETS, max(BUCKETS, rows // ROWS_PER_BUCKET))


def running_sums(groups: DataFrame, number: int) -> DataFrame:
    """``digest, total, reach``: reach is the sum of all groups up to this one."""
    marked = groups.withColumn("bucket", _bucket(F.col("digest"), number))
    sums = marked.groupBy("bucket").agg(F.sum("total").alias("held"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("bucket").orderBy("digest").rowsBetween(W.unboundedPreceding, 0)
    return marked.withColumn("inside", F.sum("total").over(inside)).join(
        F.broadcast(offsets), "bucket").select("digest", "total", (F.col("inside") + F.col("before")).alias("reach"))


def greedy_cuts(sums: DataFrame, capacities: list[int], shards: int, largest: int) -> list[list[int]]:
    """For each capacity the running sums at which a greedy walk closes its shards."""
    cuts: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(shards):
        limits = [a + c for a, c in zip(at, capacities)]
        near = sums.filter((F.col("reach") <= max(limits)) & (F.col("reach") > min(limits) - largest))
        row = near.agg(*[F.max(F.when(F.col("reach") <= limit, F.col("reach"))).alias(f"c{i}")
                         for i, limit in enumerate(limits)]).first()
        at = [a if r is None else max(a, r) for a, r in zip(at, row)]
        for own, a in zip(cuts, at):
            own.append(a)
    return cuts


def smallest_capacity(sums: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The least feasible capacity and its cuts."""
    whole, largest = sums.agg(F.max("reach"), F.max("total")).first()
    if whole is None:
        return 0, [0] * shards
    # with this capacity each shard but the last is over an equal share
    low, high = max(-(-whole // shards), largest), -(-whole // shards) + largest
    best = None
    while low < high or best is None:
        step = max(1, -(-(high - low) // CANDIDATES))
        trial = list(range(low, high, step)) + [high]
        cuts = greedy_cuts(sums, trial, shards, largest)
        first = next(i for i, own in enumerate(cuts) if own[-1] == whole)
        best = (trial[first], cuts[first])
        high = trial[first]
        low = trial[first - 1] + 1 if first else high
    return best


def cut_digests(sums: DataFrame, cuts: list[int]) -> list[str]:
    """The last digest of each shard, the last shard's left out; shards without groups
    repeat the digest before them."""
    found = {r: d for d, r in sums.filter(F.col("reach").isin(sorted(set(cuts)))).select("digest", "reach").collect()}
    return [found.get(c, "") for c in cuts[:-1]]


def numbered(rows: DataFrame, number: int) -> DataFrame:
    """``slot``: a gapless number from 0 within each shard."""
    marked = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(number)))
    counts = marked.groupBy("shard", "bucket").agg(F.count("*").alias("held"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "digest")
    placed = marked.withColumn("place", F.row_number().over(inside) - 1)
    return placed.join(F.broadcast(offsets), ["shard", "bucket"]).withColumn(
        "slot", (F.col("place") + F.col("before")).cast("long"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every document.

    The offsets that are broadcast have at most ``shards * MOST_BUCKETS`` rows.
    """
    rows = stage(sized(docs), "sized")
    groups = stage(rows.groupBy("digest").agg(F.sum("size").alias("total")), "groups")
    sums = stage(running_sums(groups, buckets_for(groups.count())), "sums")
    _, cuts = smallest_capacity(sums, shards)
    ends = cut_digests(sums, cuts)
    shard = sum((F.when(F.col("digest") > end, 1).otherwise(0) for end in ends), F.lit(0))
    placed = numbered(rows.withColumn("shard", shard.cast("int")), buckets_for(rows.count()) // shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
