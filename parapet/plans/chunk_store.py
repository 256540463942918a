"""What the flows need of a chunk store, and the store on a written table.

A store takes chunks and deletes by batch, tells which ids it holds, and searches its
current rows. Flows take any object of this shape; search is a strategy of the store.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parapet.functions.embedding import hashed_embedding
from parapet.operators import retrieval, store
from parapet.plans.answer import answer_questions, embedded_store
from parapet.sources.tables import exists


class ChunkStore(Protocol):
    """``chunk_id, source, content, metadata`` rows with vectors, keyed by id."""

    def write(self, chunks: DataFrame, batch_id: int) -> None:
        """Add chunks; a chunk replaces an earlier one of its id. May run again."""

    def delete(self, ids: DataFrame, batch_id: int) -> None:
        """Remove ids (``chunk_id``); ids that are not there change nothing. May run again."""

    def held(self, candidates: DataFrame, before: int | None = None) -> DataFrame:
        """The ids held, now or before a batch, as far as candidates can be among them."""

    def items(self) -> DataFrame:
        """``item_id, source, content, metadata, vector`` of all current chunks."""

    def search(self, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
        """``query_id, item_id, cosine, rank`` of the best k chunks of each query."""


@dataclass(frozen=True)
class WrittenStore:
    """A collection of the written table; vectors are computed once, when chunks come in."""

    spark: SparkSession
    path: str
    collection: str = store.DEFAULT_COLLECTION
    embed: Callable[[Column], Column] = hashed_embedding
    strategy: retrieval.Search = retrieval.nearest

    def write(self, chunks: DataFrame, batch_id: int) -> None:
        rows = embedded_store(store.one_per_id(chunks, ["content"]), self.embed)
        store.write_batch(rows.withColumnRenamed("item_id", "chunk_id").withColumn(
            "collection", F.lit(self.collection)), self.path, batch_id)

    def delete(self, ids: DataFrame, batch_id: int) -> None:
        store.delete_batch(ids, self.path, batch_id, self.collection)

    def held(self, candidates: DataFrame, before: int | None = None) -> DataFrame:
        return store.held_ids(self.spark, self.path, candidates, self.collection, before)

    def items(self) -> DataFrame:
        if not exists(self.spark, self.path):
            raise ValueError(f"nothing has been written to {self.path}")
        return store.read_current(self.spark, self.path, self.collection).drop("collection").withColumnRenamed(
            "chunk_id", "item_id")

    def search(self, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
        return self.strategy(queries, items, k)


def answer_from(questions: DataFrame, chunks: ChunkStore, **options) -> DataFrame:
    """``answer_questions`` over the current chunks of a store, with the store's search."""
    return answer_questions(questions, chunks.items(), search=chunks.search, **options)
