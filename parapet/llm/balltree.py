r"""Ranked lexical search: exact best inner products by sparse ball trees.

An item and a document are sparse vectors over terms; the score is their inner product in
integers. Every task puts its documents into ball trees, one per Arrow batch: a node has
the centroid of its documents and the largest distance from it, so no document below it can
score more than q.c + |q| r. Sparse vectors lie far from any centroid, mostly along terms
that an item does not have, so a node also keeps its extent along each single term, and the
smaller of both bounds counts. Nodes are opened best first; one whose bound, widened by a
margin for rounding, lies below the tenth score found so far is left closed with all below
it. Leaves are scored in 64-bit integers. A task returns the best documents of each item
among its own, and the best of these are the result. Distances are taken between vectors
scaled by the root of the term's weight, which splits the weight evenly between both sides
and leaves every inner product as it is.

Only terms of items matter to a score. Items are dealt by hash into blocks of about
``BLOCK_TERMS`` distinct terms, so what a task holds is bounded however many items there
are. For each block the documents are written once as counts of the block's terms; document
frequencies are sums over that table. Tasks read a block's terms and frequencies from the
shared folder; neither passes through the driver.

Terms are compared as 64-bit hashes. A foreign term counts as one of an item with a chance of
(terms of a block) x (other terms of the corpus) / 2**64: 4e-6 for 2**16 and 10**9.

Defined cases: null and empty texts have no terms and are not ranked; rows of the same item
id and text count once, rows of one id with different texts are ranked apart; repeated
documents are ranked each; a null document id stands behind all others of its score; other
columns are not read; without documents or items there are no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from parapet.llm.blocks import ALNUM, LOWER, Block, blocks, hashes, words
from parapet.llm.shared import open_folder, stage
from parapet.session import shared_folder

BEST = 10
BLOCK_TERMS = 1 << 16
LEAF = 64
MARGIN = 1e-9  # sums of a few thousand doubles are right to about 1e-12


def terms(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row and the hash of every term of a block, and the number of terms per row."""
    data = LOWER[block.data]
    found = words(block, ALNUM, data)
    return found.row, hashes(data, found.start, found.end), found.per_row


def _counted(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted, with the number of times each occurs."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) \
        if len(row) else np.zeros(0, np.int64)
    return row[first], value[first], np.diff(np.append(first, len(row)))


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, item_hash, term, times`` of the distinct items with terms."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            own, key, _ = terms(block)
            row, value, times = _counted(own, key.view(np.int64))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0).take(at), block.rows.column(1).take(at), pa.array(value), pa.array(times)],
                ["item_id", "item_hash", "term", "times"])

    once = items.select("item_id", "text").distinct().select("item_id", F.xxhash64("text").alias("item_hash"), "text")
    return once.mapInArrow(run, f"item_id {kind}, item_hash long, term long, times long")


def _read(folder: str) -> pa.Table:
    """A written table of bounded size, inside a task."""
    system, path = open_folder(folder)
    return pq.read_table(path, filesystem=system, partitioning=None)


def _vocabulary(items: pa.Table) -> np.ndarray:
    return np.unique(items.column("term").to_numpy())


def vectors(docs: DataFrame, item_folder: str) -> DataFrame:
    """``doc_id, n, terms, times``: the number of all terms of each document, and how often
    it holds each term of the items, as places in their sorted vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(_read(item_folder))
        for block in blocks(batches):
            row, key, per_row = terms(block)
            key = key.view(np.int64)
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            held = known[place] == key
            row, place, times = _counted(row[held], place[held])
            cuts = pa.array(np.searchsorted(row, np.arange(len(block) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                block.rows.column(0), pa.array(per_row.astype(np.int64)),
                pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32))),
                pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))],
                ["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, times array<int>")


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Items:
    """The items of a block: integer weights per term, and scaled vectors for the bounds."""

    def __init__(self, table: pa.Table, frequency: pa.Table, documents: int) -> None:
        table = table.sort_by([("item_id", "ascending"), ("item_hash", "ascending"), ("term", "ascending")])
        known = _vocabulary(table)
        self.weights = np.full(len(known), weight(documents, 0), np.int64)
        for place, count in zip(frequency.column("term").to_pylist(), frequency.column("df").to_pylist()):
            self.weights[place] = weight(documents, count)
        self.scale = np.sqrt(self.weights.astype(np.float64))
        self.term = np.searchsorted(known, table.column("term").to_numpy())
        times = table.column("times").to_numpy()
        self.whole = times * self.weights[self.term]
        self.scaled = times * self.scale[self.term]
        ids, marks = table.column("item_id").combine_chunks(), table.column("item_hash").to_numpy()
        number = np.asarray(ids.dictionary_encode().indices.fill_null(-1))
        new = np.concatenate([[True], (number[1:] != number[:-1]) | (marks[1:] != marks[:-1])])
        self.first = np.flatnonzero(new)
        self.ends = np.append(self.first[1:], len(new))
        self.ids, self.marks = ids.take(pa.array(self.first)), marks[self.first]
        self.length = np.sqrt(np.add.reduceat(self.scaled ** 2, self.first))

    def bounds(self, centroid: np.ndarray, radius: float, extent: np.ndarray) -> np.ndarray:
        """What no document within ``radius`` of the centroid, and with impacts up to
        ``extent`` per term, can exceed, for every item."""
        ball = np.add.reduceat(self.scaled * centroid[self.term], self.first) + self.length * radius
        along = np.add.reduceat(self.whole * extent[self.term], self.first)
        return np.minimum(ball * (1 + MARGIN) + 1, along)


def impacts(times: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The integer factor of each (document, term); ``n`` is the document's number of terms."""
    if len(n) and 75 * documents * int(n.max()) >= 1 << 62:
        long = np.array([75 * int(i) * documents // total for i in n], np.int64)
    else:
        long = 75 * n * documents // total
    return 1_000_000_000 * times // (1000 * times + 8 * (25 + long))


class Tree:
    """A ball tree over sparse documents; ``search`` scores what may reach the best."""

    def __init__(self, term: np.ndarray, impact: np.ndarray, cuts: np.ndarray, items: Items, leaf: int = LEAF) -> None:
        self.term, self.impact, self.cuts, self.items = term, impact, cuts, items
        self.x = impact * items.scale[term]
        self.square = self._per_row(self.x ** 2, cuts[:-1], cuts[1:])
        self.children: list[tuple[int, ...]] = []
        self.rows: list[np.ndarray] = []
        self.bound: list[np.ndarray] = []
        self.opened: dict[int, tuple] = {}
        self._grow(np.arange(len(cuts) - 1), leaf)

    @staticmethod
    def _per_row(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(values, np.minimum(begin, len(values) - 1))
        return np.where(end > begin, total, 0.0)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, and where each row begins among them."""
        long = self.cuts[rows + 1] - self.cuts[rows]
        begin = np.cumsum(long) - long
        return np.arange(int(long.sum())) + np.repeat(self.cuts[rows] - begin, long), np.append(begin, long.sum())

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        places, begin = self._entries(rows)
        term, x = self.term[places], self.x[places]
        size = len(self.items.weights)
        dot = lambda dense: self._per_row(x * dense[term], begin[:-1], begin[1:])
        centroid = np.bincount(term, x, size) / len(rows)
        square = float(centroid @ centroid)
        distance = self.square[rows] - 2 * dot(centroid) + square
        slack = MARGIN * (float(self.square[rows].max()) + square)
        extent = np.zeros(size, np.int64)
        np.maximum.at(extent, term, self.impact[places])
        node = len(self.rows)
        self.rows.append(rows)
        self.children.append(())
        radius = math.sqrt(max(float(distance.max()), 0.0) + slack)
        self.bound.append(self.items.bounds(centroid, radius, extent))
        if len(rows) > leaf:
            far = self._dense(rows[int(distance.argmax())])
            other = self._dense(rows[int((self.square[rows] - 2 * dot(far)).argmax())])
            order = np.argsort(dot(far - other), kind="stable")
            half = len(rows) // 2
            self.children[node] = (self._grow(rows[order[:half]], leaf), self._grow(rows[order[half:]], leaf))
        return node

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(len(self.items.weights))
        own = slice(self.cuts[row], self.cuts[row + 1])
        out[self.term[own]] = self.x[own]
        return out

    def _leaf(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a leaf and its impacts, one row per term and a last row of zeros."""
        if node not in self.opened:
            rows = self.rows[node]
            places, begin = self._entries(rows)
            known, place = np.unique(self.term[places], return_inverse=True)
            table = np.zeros((len(known) + 1, len(rows)), np.int64)
            table[place, np.repeat(np.arange(len(rows)), np.diff(begin))] = self.impact[places]
            self.opened[node] = known, table
        return self.opened[node]

    def scores(self, node: int, item: int) -> np.ndarray:
        """Exact scores of the documents of a leaf."""
        own = slice(self.items.first[item], self.items.ends[item])
        known, table = self._leaf(node)
        wanted = self.items.term[own]
        place = np.searchsorted(known, wanted)
        place[place == len(known)] = 0
        held = known[place] == wanted
        return self.items.whole[own][held] @ table[place[held]]

    def search(self, item: int, best: "Best") -> int:
        """Open the nodes that may hold one of the best, most promising first; returns the
        number of documents that were scored."""
        waiting, scored = [(-self.bound[0][item], 0)], 0
        while waiting and -waiting[0][0] >= best.least:
            _, node = heapq.heappop(waiting)
            for child in self.children[node]:
                if self.bound[child][item] >= best.least:
                    heapq.heappush(waiting, (-self.bound[child][item], child))
            if not self.children[node]:
                best.take(self.scores(node, item), self.rows[node])
                scored += len(self.rows[node])
        return scored


class Best:
    """The best documents of an item so far; equal scores by id, a null id last."""

    def __init__(self, most: int) -> None:
        self.most, self.least, self.held, self.ids = most, 1, [], []

    def take(self, scores: np.ndarray, rows: np.ndarray) -> None:
        if scores.max() < self.least:
            return
        found = np.flatnonzero(scores >= self.least)
        new = [(-int(scores[i]), self.ids[rows[i]] is None, self.ids[rows[i]] or 0) for i in found]
        self.held = sorted(self.held + new)[:self.most]
        if len(self.held) == self.most:
            self.least = -self.held[-1][0]


def searched(table: DataFrame, item_folder: str, df_folder: str, documents: int, total: int,
             most: int, item_type: str) -> DataFrame:
    """``item_id, item_hash, doc_id, score``: the best documents of each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(_read(item_folder), _read(df_folder), documents)
        best = [Best(most) for _ in items.first]
        for batch in batches:
            if not batch.num_rows:
                continue
            held, counts = batch.column(2), batch.column(3)
            cuts = held.offsets.to_numpy().astype(np.int64)
            n = batch.column(1).to_numpy()
            times = counts.flatten().to_numpy().astype(np.int64)
            long = np.repeat(n, np.diff(cuts))
            tree = Tree(held.flatten().to_numpy().astype(np.int64), impacts(times, long, documents, total),
                        cuts - cuts[0], items)
            ids = batch.column(0).to_pylist()
            for item, own in enumerate(best):
                own.ids = ids
                tree.search(item, own)
        at = pa.array([i for i, own in enumerate(best) for _ in own.held], pa.int64())
        rows = [row for own in best for row in own.held]
        yield pa.RecordBatch.from_arrays([
            items.ids.take(at), pa.array(items.marks).take(at),
            pa.array([None if lone else doc for _, lone, doc in rows], pa.int64()),
            pa.array([-score for score, _, _ in rows], pa.int64())],
            ["item_id", "item_hash", "doc_id", "score"])

    return table.mapInArrow(run, f"item_id {item_type}, item_hash long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, most: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, item_hash, rank, doc_id, score``: the ``most`` best documents of each item
    with a score above 0, equal scores by id."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    own = stage(item_terms(items), "item-terms")
    parts = -(-own.count() // block_terms)
    folder = shared_folder(spark, "item-blocks")
    block = F.pmod(F.xxhash64("item_id", "item_hash"), F.lit(max(parts, 1)))
    own.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(folder)
    found = spark.createDataFrame([], f"item_id {kind}, item_hash long, doc_id long, score long")
    for (part,) in spark.read.parquet(folder).select("block").distinct().collect() if parts else ():
        block_folder = f"{folder}/block={part}"
        table = stage(vectors(docs, block_folder), "vectors")
        documents, total = table.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            return _numbered(found, most)
        frequency = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        df_folder = shared_folder(spark, "frequencies")
        frequency.write.parquet(df_folder)
        found = found.unionByName(stage(searched(
            table.filter("size(terms) > 0"), block_folder, df_folder, documents, total, most, kind), "found"))
    return _numbered(found, most)


def _numbered(found: DataFrame, most: int) -> DataFrame:
    """Ranks over the best of all partitions: at most ``most`` rows of each."""
    order = Window.partitionBy("item_id", "item_hash").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(
        "item_id", "item_hash", "rank", "doc_id", "score")
