"""The whole way of a question: gateway, retrieval, generation, checks, response."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions.embedding import hashed_embedding
from parapet.operators import context, gateway, output, retrieval


def embedded_store(chunks: DataFrame, embed: Callable[[Column], Column] = hashed_embedding):
    """Chunk rows with their vectors, ready for retrieval."""
    return chunks.select(
        F.col("chunk_id").alias("item_id"), "source", "content", "metadata",
        embed(F.col("content")).alias("vector"),
    )


def kept_table(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Write a result that several later steps read, and go on from the written table."""
    if folder is None:
        return df
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def answer_questions(
    questions: DataFrame,
    store: DataFrame,
    strict: bool = True,
    embed: Callable[[Column], Column] = hashed_embedding,
    model: Callable[[pd.DataFrame], pd.Series] | None = None,
    folder: str | None = None,
    search: retrieval.Search = retrieval.nearest,
) -> DataFrame:
    """One response row per question; ``search`` finds the chunks, exactly or in cells.

    ``questions`` holds unique ``query_id``, ``text`` and ``top_k``; ``store`` comes from
    ``embedded_store`` with one row per id. Requests out of bounds (text length, ``top_k``)
    get a ``reject_reason`` and no answer. Blocked questions never reach retrieval, and a
    question without hits is answered all the same. With a ``folder`` the decisions of the
    gateway are written there as ``decisions`` and not computed again for the response.
    """
    judged = kept_table(
        gateway.evaluate(questions, "text", strict).select(
            "query_id", F.col("top_k").cast("long").alias("top_k"),
            F.col("sanitized_text").alias("question"), "query_hash",
            F.coalesce(gateway.request_problem(F.col("text"), F.col("top_k")), "reject_reason")
            .alias("reject_reason"),
            "threat_level", "score", "triggered_rules", "blocked", "rejection_reason",
        ),
        folder, "decisions",
    )
    passed = judged.where(~F.col("blocked") & F.col("reject_reason").isNull())
    asked = passed.select("query_id", "top_k", embed(F.col("question")).alias("vector"))
    found = retrieval.similarity_search(asked, store, gateway.MAX_TOP_K, search=search).select(
        "query_id", "item_id", "rank", "relevance_score"
    )
    hits = found.join(store.select("item_id", "source", "content", "metadata"), "item_id")
    collected = context.collected_hits(
        hits, F.map_entries("metadata").alias("metadata"), F.col("relevance_score")
    )
    with_hits = passed.select("query_id", "question").join(collected, "query_id", "left").select(
        "query_id", "question",
        context.context_text(F.col("_hits")).alias("context"),
        F.coalesce(F.size("_hits"), F.lit(0)).cast("long").alias("hits"),
        F.col("_hits")[0]["content"].alias("best_content"),
        F.transform(
            "_hits",
            lambda hit: F.struct(
                hit["rank"].alias("rank"),
                F.substring(hit["content"], 1, 200).alias("content_preview"),
                F.map_from_entries(hit["metadata"]).alias("metadata"),
                hit["relevance_score"].alias("relevance_score"),
            ),
        ).alias("sources"),
    )
    answered = output.sanitize_output(context.generate(context.prompts(with_hits), model))
    responses = answered.select(
        "query_id", "hits", F.col("output_text").alias("answer"), "status", "pii_types",
        "has_warnings", "sources",
    )
    return judged.select(
        "query_id", "query_hash", "reject_reason", "threat_level", "blocked", "rejection_reason"
    ).join(responses, "query_id", "left")
