"""The corpus pipeline: five stages from raw documents to digests of token ids.

Each stage takes (spark, documents, folder of the tables) and returns documents, written
as Parquet and read again as the next stage's input. Rows that a stage rejects are gone
for all later stages; the other rows keep their columns. Repeated ids, null texts and
empty tables pass through as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parapet.llm import hyperminhash, lexicon, queries, repetition, secrets, wumanber
from parapet.llm.shared import prepare, stage
from parapet.session import configure
from parapet.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the limits on repeated substrings (operator 10)."""
    prepare(configure(spark))
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five words, 0.8 (operator 9)."""
    prepare(configure(spark))
    return hyperminhash.drop_near_copies(docs, hyperminhash.Similarity(words=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item (operator 6)."""
    prepare(configure(spark))
    return wumanber.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask (operator 7)."""
    prepare(configure(spark))
    return secrets.masked(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text per document (operator 2)."""
    prepare(configure(spark))
    return lexicon.encoded(docs, queries.tokenizer_path(), with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("secret scans", secret_masking),
    ("encoding", encoding),
]

#: SQL expresses neither the suffix array nor the merges; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
