"""Queries over chunking, ids and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.functions import text as T
from parapet.operators import chunking as C, store
from parapet.plans import derived as D
from parapet.plans.derived import SP, sql_strip
from parapet.sources.tables import text_table

SPEC = C.ChunkSpec()


def _docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return text_table(spark, sf, "documents", "doc_id", "text", *columns)


def _numbered(df: DataFrame, parts, name: str) -> DataFrame:
    """One row per element with a running number, the text as its hash."""
    return df.select(
        "doc_id", F.posexplode_outer(parts).alias("pos", "part")
    ).where(F.col("part").isNotNull()).select(
        "doc_id", F.col("pos").cast("long").alias(name),
        F.length("part").cast("long").alias("chars"), F.sha2("part", 256).alias("sha"),
    )


def normalize_ws(spark: SparkSession, sf: str) -> DataFrame:
    wide = F.regexp_replace("text", r"\. ", ".   ")
    docs = _docs(spark, sf).select("doc_id", T.collapse_whitespace(wide).alias("text"))
    return docs.select(
        "doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha")
    )


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(
        _docs(spark, sf), T.paragraphs(F.regexp_replace("text", "\n", "\n \n")), "paragraph"
    )


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(_docs(spark, sf), T.sentences(F.col("text")), "sentence")


def word_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(_docs(spark, sf), C.pack_words(F.col("text"), SPEC.size), "line")


def pack_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of whole documents packed with overlap."""
    return _numbered(_docs(spark, sf), C.pack_pieces(T.sentences(F.col("text")), SPEC), "chunk")


def _chunked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with paragraph breaks after every fourth document's lines."""
    text = F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", "\n", "\n\n")).otherwise(
        F.col("text")
    )
    return C.chunk_documents(
        C.raw_documents(
            _docs(spark, sf, "source", "lang"), text, F.col("source"),
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.lit("overridden")),
            "doc_id",
        ),
        SPEC,
    )


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf).select(
        "doc_id", "source", "chunk_index", F.length("content").cast("long").alias("chars"),
        "chunk_id",
    )


def chunk_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have only one chunk, with the minimum raised to 400 characters."""
    docs = _docs(spark, sf)
    raw = docs.select("doc_id", C.raw_chunks(F.col("text"), SPEC).alias("raw"))
    kept = raw.select("doc_id", F.size("raw").alias("n"), C.keep_chunks(F.col("raw"), 400).alias("kept"))
    return kept.select(
        "doc_id", F.col("n").cast("long").alias("raw_chunks"),
        F.size("kept").cast("long").alias("kept_chunks"),
        F.length(F.col("kept")[0]).cast("long").alias("first_chars"),
    )


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf, "source").select(
        "doc_id", T.content_id(F.col("source"), F.col("text")).alias("chunk_id")
    )


def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf, "source", "lang")
    merged = docs.select(
        "doc_id",
        C.chunk_metadata(
            F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.lit("overridden")),
            F.col("source"), F.col("doc_id"),
            F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")),
            F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.lit("")),
        ).alias("m"),
    )
    keys = ("lang", "source", "chunk_index", "page", "section")
    return merged.select(
        "doc_id", F.size("m").cast("long").alias("entries"), *[F.col("m")[k].alias(k) for k in keys]
    )


def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return D.doc_chunks(spark, sf).select(
        "doc_id", "chunk_index", F.length("content").cast("long").alias("chars"), "chunk_id"
    )


def positional_ids(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return D.doc_chunks(spark, sf).select(
        "doc_id", "chunk_index", T.position_id(path, F.col("chunk_index")).alias("chunk_id")
    )


def dedup_new_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and documents arrive; the store already holds every document in English."""
    docs = D.doc_chunks(spark, sf)
    arriving = docs.unionByName(D.page_chunks(spark, sf))
    held = docs.where(F.col("lang") == "en")
    return store.new_chunks(held, arriving, ["doc_id", "chunk_index"]).select(
        "chunk_id", "doc_id", "chunk_index"
    )


def dedup_within_batch(spark: SparkSession, sf: str) -> DataFrame:
    arriving = D.doc_chunks(spark, sf).unionByName(D.page_chunks(spark, sf))
    return store.one_per_id(arriving, ["doc_id", "chunk_index"], latest=False).select(
        "chunk_id", "source", "doc_id", "chunk_index"
    )


def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.doc_chunks(spark, sf)
    arriving = docs.unionByName(D.page_chunks(spark, sf))
    sources = arriving.select("source").union(
        text_table(spark, sf, "pages", "url").select(F.col("url").alias("source"))
    )
    report = store.ingest_summary(arriving, docs.where(F.col("lang") == "en"), sources)
    return report.withColumn("warnings", T.rendered(F.col("warnings")))


QUERIES = {
    f.__name__: f
    for f in (normalize_ws, paragraphs, sentences, word_pack, pack_chunks, chunk_documents,
              chunk_fallback, chunk_ids, chunk_metadata, fixed_chunks, positional_ids,
              dedup_new_chunks, dedup_within_batch, ingest_summary)
}


def sql_sentences(expression: str) -> str:
    """List of raw sentences: the break positions are marked first, then split."""
    marked = (
        rf"regexp_replace({expression}, '([.!?]){SP}+([A-Z])', '\1' || chr(1) || '\2', 'g')"
    )
    return f"string_split(replace({marked}, chr(10), chr(10) || chr(1)), chr(1))"


def sql_pieces(source: str, name: str) -> str:
    """CTE with numbered, stripped, non-empty list elements of ``source(doc_id, parts)``."""
    return f"""{name}_u AS (
  SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS n FROM {source}
), {name} AS (
  SELECT doc_id, {sql_strip('part')} AS part,
         row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i
  FROM {name}_u WHERE {sql_strip('part')} <> ''
)"""


def sql_pack(pieces: str, name: str, size: int, overlap: int) -> str:
    """Recursive CTEs that pack ``pieces(doc_id, i, part)``, one step per piece."""
    tail = f"right(s.body, {overlap}) || ' '" if overlap else "''"
    full = f"s.used + length(p.part) > {size}"
    return f"""{name}_s AS (
  SELECT doc_id, i, part AS body, length(part) + 1 AS used, '' AS lead,
         CAST(NULL AS VARCHAR) AS done FROM {pieces} WHERE i = 1
  UNION ALL
  SELECT s.doc_id, p.i, CASE WHEN {full} THEN p.part ELSE s.body || ' ' || p.part END,
         CASE WHEN {full} THEN length(p.part) + 1 ELSE s.used + length(p.part) + 1 END,
         CASE WHEN {full} THEN {tail} ELSE s.lead END,
         CASE WHEN {full} THEN s.lead || s.body END
  FROM {name}_s s JOIN {pieces} p ON p.doc_id = s.doc_id AND p.i = s.i + 1
), {name}_all AS (
  SELECT doc_id, i, {sql_strip('done')} AS chunk FROM {name}_s WHERE done IS NOT NULL
  UNION ALL
  SELECT doc_id, max(i) + 1, {sql_strip("arg_max(lead || body, i)")} FROM {name}_s GROUP BY doc_id
), {name} AS (
  SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n
  FROM {name}_all
)"""


def sql_word_pack(source: str, name: str, size: int) -> str:
    """Recursive CTEs that fill lines with the words of ``source(doc_id, part)``."""
    full = f"s.used + length(p.part) + 1 > {size}"
    return f"""{name}_w AS (
  SELECT doc_id, string_split_regex(part, '{SP}+') AS parts FROM {source}
), {sql_pieces(f"{name}_w", f"{name}_p")}, {name}_s AS (
  SELECT doc_id, i, part AS line, length(part) + 1 AS used, CAST(NULL AS VARCHAR) AS done
  FROM {name}_p WHERE i = 1
  UNION ALL
  SELECT s.doc_id, p.i, CASE WHEN {full} THEN p.part ELSE s.line || ' ' || p.part END,
         CASE WHEN {full} THEN length(p.part) + 1 ELSE s.used + length(p.part) + 1 END,
         CASE WHEN {full} THEN s.line END
  FROM {name}_s s JOIN {name}_p p ON p.doc_id = s.doc_id AND p.i = s.i + 1
), {name}_all AS (
  SELECT doc_id, i, done AS line FROM {name}_s WHERE done IS NOT NULL
  UNION ALL
  SELECT doc_id, max(i) + 1, arg_max(line, i) FROM {name}_s GROUP BY doc_id
), {name} AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n
  FROM {name}_all
)"""


def sql_chunks(source: str, size: int, overlap: int) -> str:
    """CTEs from ``source(doc_id, text)`` to ``raw(doc_id, chunk, n)``: every chunk of a text."""
    return f"""norm AS (
  SELECT doc_id, string_split_regex(regexp_replace(text, '{SP}{{3,}}', '  ', 'g'),
         '\\n{SP}*\\n') AS parts FROM {source}
), {sql_pieces('norm', 'para')}, sent_src AS (
  SELECT doc_id * 100000 + i AS doc_id, {sql_sentences('part')} AS parts FROM para
  WHERE length(part) > {size}
), {sql_pieces('sent_src', 'sent')}, long_s AS (
  SELECT doc_id * 100000 + i AS doc_id, part FROM sent WHERE length(part) > {size}
), {sql_word_pack('long_s', 'lines', size)}, flat AS (
  SELECT doc_id, i AS a, 0 AS b, 0 AS c, part FROM para WHERE length(part) <= {size}
  UNION ALL
  SELECT doc_id // 100000, doc_id % 100000, i, 0, part FROM sent WHERE length(part) <= {size}
  UNION ALL
  SELECT doc_id // 10000000000, doc_id // 100000 % 100000, doc_id % 100000, n, line FROM lines
), pieces AS (
  SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, c) AS i FROM flat
), {sql_pack('pieces', 'raw', size, overlap)}"""


def sql_kept(minimum: int) -> str:
    return f"""kept AS (
  SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index
  FROM raw r WHERE length(chunk) >= {minimum}
     OR (n = 0 AND NOT EXISTS (SELECT 1 FROM raw o WHERE o.doc_id = r.doc_id
                               AND length(o.chunk) >= {minimum}))
)"""


_TEXTS = """texts AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(text, chr(10), chr(10) || chr(10))
         ELSE text END AS text FROM documents)"""
_HASHED = "length(part) AS chars, sha256(part) AS sha"
_ARRIVING = f"""{D.DOC_CHUNKS}, {D.PAGE_CHUNKS}, arriving AS (
  SELECT * FROM doc_chunks UNION ALL SELECT * FROM page_chunks
)"""
_FIRST = """first_rows AS (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, chunk_index) AS r
  FROM arriving
)"""
_HELD = "(SELECT chunk_id FROM doc_chunks WHERE lang = 'en')"

ORACLE = {
    "normalize_ws": f"""WITH t AS (
  SELECT doc_id, regexp_replace(replace(text, '. ', '.   '), '{SP}{{3,}}', '  ', 'g') AS text
  FROM documents)
SELECT doc_id, length(text) AS chars, sha256(text) AS sha FROM t""",
    "paragraphs": f"""WITH src AS (
  SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)),
         '\\n{SP}*\\n') AS parts FROM documents
), {sql_pieces('src', 'p')}
SELECT doc_id, i - 1 AS paragraph, {_HASHED} FROM p""",
    "sentences": f"""WITH src AS (
  SELECT doc_id, {sql_sentences('text')} AS parts FROM documents
), {sql_pieces('src', 'p')}
SELECT doc_id, i - 1 AS sentence, {_HASHED} FROM p""",
    "word_pack": f"""WITH RECURSIVE src AS (SELECT doc_id, text AS part FROM documents),
{sql_word_pack('src', 'lines', SPEC.size)}
SELECT doc_id, n AS line, length(words) AS chars, sha256(words) AS sha
FROM (SELECT doc_id, n, line AS words FROM lines)""",
    "pack_chunks": f"""WITH RECURSIVE src AS (
  SELECT doc_id, {sql_sentences('text')} AS parts FROM documents
), {sql_pieces('src', 'p')}, {sql_pack('p', 'packed', SPEC.size, SPEC.overlap)}
SELECT doc_id, n AS chunk, length(body) AS chars, sha256(body) AS sha
FROM (SELECT doc_id, n, chunk AS body FROM packed)""",
    "chunk_documents": f"""WITH RECURSIVE {_TEXTS},
{sql_chunks('texts', SPEC.size, SPEC.overlap)}, {sql_kept(SPEC.minimum)}
SELECT doc_id, source, chunk_index, length(chunk) AS chars,
       substr(sha256(source || ':' || chunk), 1, 32) AS chunk_id
FROM kept JOIN documents USING (doc_id)""",
    "chunk_fallback": f"""WITH RECURSIVE texts AS (SELECT doc_id, text FROM documents),
{sql_chunks('texts', SPEC.size, SPEC.overlap)}, {sql_kept(400)}
SELECT doc_id, (SELECT count(*) FROM raw r WHERE r.doc_id = k.doc_id) AS raw_chunks,
       count(*) AS kept_chunks, arg_min(length(chunk), chunk_index) AS first_chars
FROM kept k GROUP BY doc_id""",
    "chunk_ids": """SELECT doc_id, substr(sha256(source || ':' || text), 1, 32) AS chunk_id
FROM documents""",
    "chunk_metadata": """SELECT doc_id,
  CAST(3 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END
         + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS entries, lang, source,
  CAST(doc_id AS VARCHAR) AS chunk_index,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS page,
  CASE WHEN doc_id % 3 = 0 THEN lang END AS section FROM documents""",
    "fixed_chunks": f"""WITH {D.DOC_CHUNKS}
SELECT doc_id, chunk_index, length(content) AS chars, chunk_id FROM doc_chunks""",
    "positional_ids": f"""WITH {D.DOC_CHUNKS}
SELECT doc_id, chunk_index,
       substr(sha256(source || '/' || doc_id || ':' || chunk_index), 1, 32) AS chunk_id
FROM doc_chunks""",
    "dedup_new_chunks": f"""WITH {_ARRIVING}, {_FIRST}
SELECT chunk_id, doc_id, chunk_index FROM first_rows
WHERE r = 1 AND chunk_id NOT IN {_HELD}""",
    "dedup_within_batch": f"""WITH {_ARRIVING}, {_FIRST}
SELECT chunk_id, source, doc_id, chunk_index FROM first_rows WHERE r = 1""",
    "ingest_summary": f"""WITH {_ARRIVING}, sources AS (
  SELECT source FROM arriving UNION SELECT url FROM pages
), counted AS (
  SELECT source, count(*) FILTER (WHERE chunk_id NOT IN {_HELD}) AS created,
         count(*) FILTER (WHERE chunk_id IN {_HELD}) AS skipped
  FROM arriving GROUP BY source
)
SELECT source, coalesce(created, 0) AS chunks_created, coalesce(skipped, 0) AS duplicates_skipped,
       CASE WHEN created IS NULL THEN
       'No chunks produced — file may be empty or unreadable.' ELSE '' END AS warnings,
       'documents' AS collection
FROM sources LEFT JOIN counted USING (source)""",
}
