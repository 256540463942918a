"""Queries over embedding, retrieval, context and generation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.functions import signatures as S, text as T
from parapet.functions.embedding import DIMENSIONS, embedder, hashed_embedding
from parapet.operators import chunking as C, context as X, intake, retrieval as R, store
from parapet.plans import derived as D
from parapet.plans.answer import kept_table
from parapet.plans.chunk_store import WrittenStore, answer_from
from parapet.plans.derived import SP, sql_strip
from parapet.plans.ingest import ingest
from parapet.plans.q_chunks import SPEC, sql_chunks, sql_kept, sql_pieces, sql_sentences
from parapet.plans.q_gateway import sql_gateway
from parapet.plans.q_output import sql_sanitized
from parapet.session import shared_folder
from parapet.sources.tables import table, text_table

PLACES = 6
THRESHOLD = 0.65
NEAR = 0.9


def _vectors(spark: SparkSession, sf: str, sign: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Every vector is asked for, against all vectors."""
    rows = table(spark, sf, "embeddings")
    wide = F.col("embedding").cast("array<double>")
    asked = rows.select(
        F.col("vec_id").alias("query_id"), F.transform(wide, lambda x: x * sign).alias("vector")
    )
    return asked, rows.select(F.col("vec_id").alias("item_id"), wide.alias("vector"))


def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents", "doc_id", "text")
    rows = docs.select("doc_id", hashed_embedding(F.col("text")).alias("v")).select(
        "doc_id", F.posexplode_outer("v").alias("bucket", "w")
    )
    return rows.where(F.col("w") > 0).select(
        "doc_id", F.col("bucket").cast("long").alias("bucket"),
        F.round("w", PLACES).alias("weight"),
    )


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    asked, items = _vectors(spark, sf)
    return R.nearest(asked, items, 5).select(
        "query_id", "item_id", "rank", "cosine"
    )


def similarity_score(spark: SparkSession, sf: str) -> DataFrame:
    asked, items = _vectors(spark, sf)
    return R.similarity_search(asked, items, 5).select(
        "query_id", "item_id", "relevance_score"
    )


def knn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Each query has its own k; hits below the threshold are cut after ranking."""
    asked, items = _vectors(spark, sf)
    asked = asked.withColumn("top_k", 1 + F.col("query_id") % 20)
    return R.similarity_search(asked, items, 20, THRESHOLD).select("query_id", "item_id", "rank")


def metadata_text(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in the metadata become text."""
    meta = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select(
        "event_id", X.text_metadata(meta)["k"].alias("k")
    )


def knn_lsh(spark: SparkSession, sf: str) -> DataFrame:
    asked, items = _vectors(spark, sf)
    return R.nearest_approx(asked, items, 5, DIMENSIONS).select(
        "query_id", "item_id", "rank", "cosine"
    )


def knn_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Search in trained cells with its defaults against exact search, all vectors asked."""
    asked, items = _vectors(spark, sf)
    report = R.recall(R.CellSearch()(asked, items, 5), R.nearest(asked, items, 5))
    return report.select("expected", (F.col("found") >= NEAR * F.col("expected")).alias("reached"))


def source_previews(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents", "doc_id", "text", "lang").select(
        "doc_id", F.col("text").alias("content"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        F.lit(1.0).alias("relevance_score"),
    )
    return X.source_previews(docs, "doc_id").select(
        "doc_id", "content_preview", F.col("metadata")["lang"].alias("lang"), "relevance_score"
    )


def _contexts(spark: SparkSession, sf: str, sign: float, threshold: float) -> DataFrame:
    """Vectors retrieve vectors; a hit shows the document of the same number."""
    asked, items = _vectors(spark, sf, sign)
    docs = text_table(spark, sf, "documents", "doc_id", "text", "source", "lang").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("content"),
        F.when(F.col("lang") != "es", F.col("source")).alias("source"),
    )
    hits = R.similarity_search(asked, items, 5, threshold).join(docs, "item_id")
    return X.context_blocks(asked.select("query_id"), hits)


def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts(spark, sf, 1.0, THRESHOLD).select(
        "query_id", "hits", F.length("context").cast("long").alias("chars"),
        F.sha2("context", 256).alias("sha"),
    )


def empty_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Opposite vectors find nothing above the threshold and still get a context."""
    return _contexts(spark, sf, -1.0, NEAR).select("query_id", "hits", "context")


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The turn before a user turn serves as its context."""
    turns = table(spark, sf, "conversations")
    before = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context")
    )
    asked = turns.where(F.col("role") == "user").join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.col("text").alias("question"),
        F.coalesce("context", F.lit(X.NO_CONTEXT)).alias("context"),
    )
    rows = X.prompts(asked)
    return rows.select(
        "conv_id", "turn", F.col("messages")[0]["role"].alias("first_role"),
        F.sha2(F.col("messages")[0]["content"], 256).alias("system_sha"),
        F.col("messages")[1]["role"].alias("second_role"),
        F.sha2(F.col("messages")[1]["content"], 256).alias("user_sha"),
        "temperature", "max_tokens",
    )


def extractive_answers(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents", "doc_id", "text")
    rows = X.generate(docs, None, "text")
    return rows.select(
        "doc_id", F.length("raw_output").cast("long").alias("chars"),
        F.sha2("raw_output", 256).alias("sha"),
    )


def own_generator(spark: SparkSession, sf: str) -> DataFrame:
    """A user's batch model writes the answers."""
    docs = text_table(spark, sf, "documents", "doc_id", "lang", "text")
    rows = X.generate(docs, lambda frame: frame["lang"] + ":" + frame["text"].str.len().astype(str))
    return rows.select("doc_id", "raw_output")


def own_embedder(spark: SparkSession, sf: str) -> DataFrame:
    """A user's batch model makes the vectors."""
    def shape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), float(t.count(" ")), 1.0])

    docs = text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", embedder(shape)("text").alias("vector"))
    return docs.select("doc_id", *[F.col("vector")[i].cast("long").alias(name) for i, name in enumerate(
        ("chars", "blanks", "one"))])


def answer_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "conversations").select(
        "conv_id", "turn", T.word_count(F.col("text")).alias("tokens")
    )


def _stored_chunks(spark: SparkSession, sf: str) -> WrittenStore:
    """Chunk the documents and write them with their vectors in two batches, as ingest jobs
    would, the first with chunks that are deleted and come again."""
    docs = C.raw_documents(
        text_table(spark, sf, "documents", "text", "source", "lang"), F.col("text"),
        F.col("source"), F.create_map(F.lit("lang"), F.col("lang")),
    )
    chunks = kept_table(store.one_per_id(C.chunk_documents(docs), ["chunk_index", "content"]),
                        shared_folder(spark, "chunks"), "all")
    written = WrittenStore(spark, shared_folder(spark, "embedded-chunks"))
    written.write(chunks, 0)
    some = chunks.where(F.substring("chunk_id", 1, 1) < "4")
    written.delete(some.select("chunk_id"), 0)
    written.write(some, 1)
    return written


def answer_flow(spark: SparkSession, sf: str) -> DataFrame:
    """User turns of the conversations, some with an attack at the end, as questions."""
    questions = text_table(spark, sf, "conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat("text", F.lit(" "), D.payload(F.col("conv_id"))).alias("text"),
        (F.col("conv_id") % 23).alias("top_k"),
    )
    rows = answer_from(
        questions, _stored_chunks(spark, sf), folder=shared_folder(spark, "answers")
    )
    return rows.select(
        "query_id", F.substring("query_hash", 1, 16).alias("short_hash"), "threat_level",
        "reject_reason", "blocked", "rejection_reason", "hits", "status", "answer",
        T.rendered(F.col("pii_types")).alias("pii_types"),
        F.col("sources")[0]["relevance_score"].alias("best_score"),
        F.col("sources")[0]["content_preview"].alias("best_preview"),
        F.array_join(F.transform("sources", lambda s: F.concat_ws(
            "|", s["rank"].cast("string"), F.format_string("%.4f", s["relevance_score"]),
            F.sha2(s["content_preview"], 256))), ",").alias("all_sources"),
    )


def ingest_flow(spark: SparkSession, sf: str) -> DataFrame:
    """All pages and documents as uploads, against a table that holds the pages already."""
    files = intake.file_rows(
        D.raw_files(spark, sf), F.col("name"), F.col("content"), F.lit(None).cast("string")
    )
    pages = files.where(F.col("filename").startswith("page_"))
    path = shared_folder(spark, "held-chunks")
    first, _, _ = ingest(pages, spark.createDataFrame([], "chunk_id string"))
    store.write_batch(first, path, 0)
    _, summary, _ = ingest(files, store.read_current(spark, path))
    return summary.drop("upload_id").withColumn("warnings", T.rendered(F.col("warnings")))


QUERIES = {
    f.__name__: f
    for f in (embed_hash, knn_exact, similarity_score, knn_threshold, metadata_text, knn_lsh, knn_recall, own_generator, own_embedder,
              source_previews, context_blocks, empty_retrieval, prompts, extractive_answers,
              answer_tokens, answer_flow, ingest_flow)
}


def sql_embedding(source: str) -> str:
    """CTE ``weights(id, bucket, w)`` from ``source(id, text)``."""
    return f"""tok AS (
  SELECT id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {source}
), tf AS (
  SELECT id, CAST('0x' || substr(md5(t), 1, 2) AS INTEGER) % {DIMENSIONS} AS bucket,
         CAST(count(*) AS DOUBLE) AS c
  FROM tok WHERE t <> '' GROUP BY 1, 2
), weights AS (
  SELECT id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM tf
)"""


def sql_ranked(sign: int = 1) -> str:
    return f"""v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), pair AS (
  SELECT q.vec_id AS query_id, s.vec_id AS item_id,
         {sign} * list_cosine_similarity(q.e, s.e) AS cosine FROM v q, v s
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, item_id)
         AS rank FROM pair
), scored AS (
  SELECT *, greatest(0.0, least(1.0, (1 + cosine) / 2)) AS similarity FROM ranked
)"""


def sql_context(hits: str) -> str:
    return f"""blocks AS (
  SELECT query_id, count(*) AS hits, string_agg('[' || place || '] Source: ' ||
         CASE WHEN lang <> 'es' THEN source ELSE 'unknown' END || chr(10) || text,
         chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place
        FROM ({hits}) h JOIN documents d ON d.doc_id = h.item_id) GROUP BY query_id
), contexts AS (
  SELECT vec_id AS query_id, coalesce(hits, 0) AS hits,
         coalesce(context, '{X.NO_CONTEXT}') AS context
  FROM embeddings LEFT JOIN blocks ON query_id = vec_id
)"""


_SYSTEM = "'" + X.SYSTEM_PROMPT.replace("'", "''") + "'"

ORACLE = {
    "embed_hash": f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {sql_embedding('src')}
SELECT id AS doc_id, CAST(bucket AS BIGINT) AS bucket, round(w, {PLACES}) AS weight FROM weights""",
    "knn_exact": f"""WITH {sql_ranked()}
SELECT query_id, item_id, rank, round(cosine, {R.PLACES}) AS cosine FROM ranked WHERE rank <= 5""",
    "knn_lsh": f"""WITH size AS (
  SELECT greatest(4, CASE WHEN count(*) < {R.CELL_ROWS} THEN 0
         ELSE 1 + CAST(floor(log2(count(*) // {R.CELL_ROWS})) AS INTEGER) END) AS bits FROM embeddings
), plane AS (
  SELECT t, b, p, d, bits, CASE WHEN x * x * x % {R.PRIME} * 48271 % {R.PRIME} // 4096 % 2 = 1
         THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS w
  FROM (SELECT *, (t * bits + b) * {DIMENSIONS} + d + 12345 AS x, t * bits + b AS p
        FROM (SELECT bits, unnest(range(8)) AS t FROM size), (SELECT unnest(range(32)) AS b),
             (SELECT unnest(range({DIMENSIONS})) AS d) WHERE b < bits)
), normal AS (
  SELECT t, b, bits, list(w ORDER BY d) AS n FROM plane GROUP BY t, b, bits
), v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), cell AS (
  SELECT vec_id, t, sum(CASE WHEN round(list_dot_product(e, n), {R.PLACES}) > 0 THEN 1 << b ELSE 0 END) AS key
  FROM v, normal GROUP BY vec_id, t
), mask AS (
  SELECT m FROM (SELECT bits, unnest(range(1 << bits)) AS m FROM size) WHERE bit_count(m) <= (bits + 3) // 4
), met AS (
  SELECT DISTINCT q.vec_id AS query_id, s.vec_id AS item_id
  FROM (SELECT vec_id, t, xor(CAST(key AS BIGINT), m) AS key FROM cell, mask) q JOIN cell s USING (t, key)
), ranked AS (
  SELECT query_id, item_id, round(list_cosine_similarity(q.e, s.e), {R.PLACES}) AS cosine
  FROM met JOIN v q ON q.vec_id = query_id JOIN v s ON s.vec_id = item_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS rank FROM ranked
)
SELECT query_id, item_id, rank, cosine FROM placed WHERE rank <= 5""",
    "own_generator": """SELECT doc_id, lang || ':' || length(text) AS raw_output FROM documents""",
    "own_embedder": """SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS blanks,
  CAST(1 AS BIGINT) AS one FROM documents""",
    "knn_recall": """SELECT count(*) * least(5, count(*)) AS expected, TRUE AS reached FROM embeddings""",
    "similarity_score": f"""WITH {sql_ranked()}
SELECT query_id, item_id, round(similarity, 4) AS relevance_score FROM scored WHERE rank <= 5""",
    "knn_threshold": f"""WITH {sql_ranked()}
SELECT query_id, item_id, rank FROM scored
WHERE rank <= 1 + query_id % 20 AND similarity >= {THRESHOLD}""",
    "metadata_text": """SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k
FROM events""",
    "source_previews": """SELECT doc_id, substr(text, 1, 200) AS content_preview, lang,
       CAST(1.0 AS DOUBLE) AS relevance_score FROM documents""",
    "context_blocks": f"""WITH {sql_ranked()},
{sql_context(f'SELECT * FROM scored WHERE rank <= 5 AND similarity >= {THRESHOLD}')}
SELECT query_id, hits, length(context) AS chars, sha256(context) AS sha FROM contexts""",
    "empty_retrieval": f"""WITH {sql_ranked(-1)},
{sql_context(f'SELECT * FROM scored WHERE rank <= 5 AND similarity >= {NEAR}')}
SELECT query_id, hits, context FROM contexts""",
    "prompts": f"""SELECT c.conv_id, c.turn, 'system' AS first_role, sha256({_SYSTEM}) AS system_sha,
  'user' AS second_role,
  sha256('CONTEXT:' || chr(10) || coalesce(b.text, '{X.NO_CONTEXT}') || chr(10) || chr(10)
         || 'QUESTION: ' || c.text) AS user_sha,
  CAST(0.1 AS DOUBLE) AS temperature, CAST(1024 AS BIGINT) AS max_tokens
FROM conversations c LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn + 1 = c.turn
WHERE c.role = 'user'""",
    "extractive_answers": f"""WITH src AS (
  SELECT doc_id, {sql_sentences('text')} AS parts FROM documents
), {sql_pieces('src', 'p')}, a AS (
  SELECT d.doc_id, coalesce(p.part, '{X.NO_ANSWER}') AS t
  FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND p.i = 1)
SELECT doc_id, length(t) AS chars, sha256(t) AS sha FROM a""",
    "answer_tokens": f"""SELECT conv_id, turn, CAST(len(list_filter(
  string_split_regex(text, '{SP}+'), lambda w: w <> '')) AS BIGINT) AS tokens FROM conversations""",
}


def sql_answer_flow() -> str:
    """The question flow in SQL: gateway, chunks, hashed vectors, ranking, answer, checks."""
    asked = f"""questions AS (
  SELECT conv_id * 1000 + turn AS query_id, text || ' ' || {D.sql_payload('conv_id')} AS text
  FROM conversations WHERE role = 'user'
)"""
    first_sentence = f"""list_filter(list_transform({sql_sentences('content')},
    lambda s: {sql_strip('s')}), lambda s: s <> '')[1]"""
    return f"""WITH RECURSIVE {sql_gateway(S.SUSPICIOUS_SCORE).replace(D.QUESTIONS, asked)},
texts AS (SELECT doc_id, text FROM documents),
{sql_chunks('texts', SPEC.size, SPEC.overlap)}, {sql_kept(SPEC.minimum)}, stored AS (
  SELECT DISTINCT substr(sha256(source || ':' || chunk), 1, 32) AS item_id, chunk AS content
  FROM kept JOIN documents USING (doc_id)
), words AS (
  SELECT item_id AS id, content AS text FROM stored
  UNION ALL SELECT 'q' || query_id, sanitized_text FROM decided
    WHERE NOT blocked AND query_id // 1000 % 23 BETWEEN 1 AND 20
), {sql_embedding('words')}, pair AS (
  SELECT q.id AS qid, c.id AS item_id, round(sum(q.w * c.w), {R.PLACES}) AS cosine
  FROM weights q JOIN weights c ON c.bucket = q.bucket AND c.id NOT LIKE 'q%'
  WHERE q.id LIKE 'q%' GROUP BY q.id, c.id
), ranked AS (
  SELECT CAST(substr(qid, 2) AS BIGINT) AS query_id, item_id, cosine,
         row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, item_id) AS rank FROM pair
), hit AS (SELECT * FROM ranked WHERE rank <= query_id // 1000 % 23), listed AS (
  SELECT query_id, string_agg(rank || '|' || printf('%.4f', round(greatest(0.0, least(1.0, (1 + cosine) / 2)), 4))
         || '|' || sha256(substr(content, 1, 200)), ',' ORDER BY rank) AS all_sources
  FROM hit JOIN stored USING (item_id) GROUP BY query_id
), best AS (
  SELECT query_id, content, round(greatest(0.0, least(1.0, (1 + cosine) / 2)), 4) AS best_score,
         (SELECT count(*) FROM hit o WHERE o.query_id = h.query_id) AS hits
  FROM hit h JOIN stored USING (item_id) WHERE rank = 1
), outs AS (
  SELECT query_id, coalesce({first_sentence}, '{X.NO_ANSWER}') AS raw_output FROM best
), {sql_sanitized('outs')}
SELECT query_id, substr(query_hash, 1, 16) AS short_hash, threat_level,
       CASE WHEN query_id // 1000 % 23 NOT BETWEEN 1 AND 20 THEN 'top_k_out_of_range' END AS reject_reason, blocked,
       rejection_reason, all_sources, hits, status, output_text AS answer, pii_types, best_score,
       substr(content, 1, 200) AS best_preview
FROM decided LEFT JOIN best USING (query_id) LEFT JOIN listed USING (query_id) LEFT JOIN sanitized USING (query_id)"""


ORACLE["answer_flow"] = sql_answer_flow()
