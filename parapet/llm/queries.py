"""The registered queries of this folder, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parapet.llm import (
    balltree, chat, hyperlang, hyperminhash, lexicon, minimax, ppm, quality, repetition, secrets, variants, warc,
    wumanber)
from parapet.llm.oracle import ORACLE  # noqa: F401  the SQL beside the queries
from parapet.llm.shared import prepare
from parapet.session import configure
from parapet.sources.tables import table


def _docs(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return table(prepare(configure(spark)), folder, name)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(_docs(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return lexicon.encoded(_docs(spark, folder), tokenizer_path(), with_ids=False)


def op3_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.scored(_docs(spark, folder))


def op4_minimax(spark: SparkSession, folder: str) -> DataFrame:
    return minimax.sharded(_docs(spark, folder))


def op5_random_indexing(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rated(_docs(spark, folder), _docs(spark, folder, "labels"))


def op6_wu_manber(spark: SparkSession, folder: str) -> DataFrame:
    return wumanber.digest(wumanber.contamination(
        _docs(spark, folder), _docs(spark, folder, "benchmark")))


def op7_markov_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(_docs(spark, folder).select("doc_id", "text")))


def op8_hyperdimensional(spark: SparkSession, folder: str) -> DataFrame:
    return hyperlang.identified(_docs(spark, folder))


def op9_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    like = hyperminhash.Similarity(words=3, percent=85)
    return hyperminhash.near_groups(_docs(spark, folder), like).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op10_suffix_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.measure(_docs(spark, folder)).drop("longest_repeat")


def op11_prefix_suffix_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return variants.grouped(_docs(spark, folder))


#: A conversation of two turns that are made of control strings, beside those of the table.
CONTROL_TURNS = """SELECT conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)"""


def op12_relational_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _docs(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.read_back(chat.formatted(turns.unionByName(spark.sql(CONTROL_TURNS)))))


def op13_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    return balltree.ranked(_docs(spark, folder), _docs(spark, folder, "benchmark")).select(
        "item_id", "rank", "doc_id", "score")


QUERIES = {q.__name__: q for q in (
    op1_warc, op2_bpe_lexicon, op3_ppm, op4_minimax, op5_random_indexing, op6_wu_manber,
    op7_markov_secrets, op8_hyperdimensional, op9_hyperminhash, op10_suffix_repetition, op11_prefix_suffix_tiling,
    op12_relational_chat, op13_ball_tree)}
