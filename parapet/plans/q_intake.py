"""Queries over decoding and parsing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.functions import magic
from parapet.operators import intake
from parapet.plans import derived as D
from parapet.plans.derived import sql_strip
from parapet.plans.ingest import prepare
from parapet.session import shared_folder
from parapet.sources.files import uploads
from parapet.sources.tables import table, text_table

UPLOAD_LIMIT = 16_384  # a smaller limit than the default, so that some files exceed it


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return intake.file_rows(
        D.raw_files(spark, sf), F.col("name"), F.col("content"), F.lit(None).cast("string")
    )


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return intake.with_type(intake.guard_size(_files(spark, sf), UPLOAD_LIMIT))


def decode_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every second document arrives as Latin-1."""
    latin = F.regexp_replace("text", r"[^\x00-\xff]", "?")
    docs = text_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 1, F.encode(latin, "ISO-8859-1"))
        .otherwise(F.encode("text", "UTF-8")).alias("content"),
    )
    text = docs.select("doc_id", intake.decode_text(F.col("content")).alias("text"))
    return text.select(
        "doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha")
    )


def detect_mime(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    return files.select(
        "filename", "length", magic.detect_mime(F.col("content"), F.col("filename")).alias("mime")
    )


def supported_split(spark: SparkSession, sf: str) -> DataFrame:
    typed = intake.with_type(_files(spark, sf).withColumn("reason", F.lit(None).cast("string")))
    return typed.groupBy("mime", F.coalesce("reason", F.lit("supported")).alias("state")).agg(
        F.count("*").alias("files")
    )


def strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    pages = text_table(spark, sf, "pages", "page_id", "html")
    text = pages.select("page_id", intake.strip_markup(F.col("html")).alias("text"))
    return text.select(
        "page_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha")
    )


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a document stand for its pages."""
    docs = text_table(spark, sf, "documents", "doc_id", "text").select(
        F.col("doc_id").cast("string").alias("source"), F.split("text", "\n").alias("pages")
    )
    return intake.page_rows(docs, "source", "pages").select(
        "source", F.col("page_number").cast("long").alias("page_number"),
        F.sha2("content", 256).alias("sha"), F.col("metadata")["total_pages"].alias("total_pages"),
    )


def section_split(spark: SparkSession, sf: str) -> DataFrame:
    """The user turns of a conversation stand for headings."""
    paragraphs = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("pos"),
        F.when(F.col("role") == "user", "Heading 1").otherwise("Normal").alias("style"), "text",
    )
    return intake.section_rows(paragraphs).select(
        "source", F.col("section_no").cast("long").alias("section_no"), "section",
        F.sha2("content", 256).alias("sha"),
    )


#: Inputs in which types and plain prose are easily confused, by the rest of the id.
TRICKY = (
    b"Convert WEBP to png: ", b"All the WAVE files: ", b"The ftyp box: ", b"Take AVI out: ",
    b"RIFF\x04\x01\x01\x01WEBP", b"RIFF\x04\x01\x01\x01WAVE", b"\x00\x00\x01\x20ftypisom",
    b"PK\x03\x04" + b"\x01" * 26 + b"password/a.txt", b"PK\x03\x04" + b"\x01" * 26 + b"word/document.xml",
    b"Also word/ and PK\x03\x04: ",
)


def mime_tricky(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that begin with words and marks of other types, as whole files."""
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    start = F.element_at(F.array(*[F.lit(t) for t in TRICKY]), (F.col("doc_id") % len(TRICKY) + 1).cast("int"))
    return docs.select("doc_id", magic.detect_mime(F.concat(start, "body"), F.lit("note.txt")).alias("mime"))


def strip_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with headings, emphasis, links and signs that a renderer escapes."""
    key = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# Title "), key, F.lit("\n\n**bold "), key, F.lit(
        "** and [link](http://x/y) with Tom & \"Jerry\" 1 < 2\n\n- item\n\n"), F.regexp_replace("text", r"[^\p{L}\p{N} .,\n]", ""))
    rows = text_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", intake.strip_markdown(text).alias("plain"))
    return rows.select("doc_id", F.length("plain").cast("long").alias("chars"), F.sha2("plain", 256).alias("sha"))


def markdown_code(spark: SparkSession, sf: str) -> DataFrame:
    """Documents inside fences and between backticks, full of signs that mean nothing there."""
    name = F.concat(F.lit("__x"), F.col("doc_id").cast("string"), F.lit("__"))
    text = F.concat(
        F.lit("## Code\n\n**see `"), name, F.lit("` here**\n\n```\n# "), name, F.lit(" <*p> **kw\n- "),
        F.regexp_replace("text", r"[`~&<>\x{fdd0}\x{fdd1}]", ""), F.lit("\n```\n*after* "), name)
    rows = text_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", intake.strip_markdown(text).alias("plain"))
    return rows.select("doc_id", F.length("plain").cast("long").alias("chars"), F.sha2("plain", 256).alias("sha"))


def decode_replacing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with two bytes that are not UTF-8 in front, between and behind."""
    broken = F.unhex(F.lit("FF"))
    content = F.concat(broken, F.encode("text", "UTF-8"), broken, F.encode(F.col("doc_id").cast("string"), "UTF-8"), broken)
    return text_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.sha2(intake.decode_replacing(content), 256).alias("sha"))


def scanned_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of several kinds in folders; text and markdown files are found."""
    folder = shared_folder(spark, "scan")
    docs = text_table(spark, sf, "documents", "doc_id", "text")
    kinds = {0: "a/x.txt", 1: "a/b/y.md", 2: "z.TXT", 3: "c/w.html"}

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                system, path = pafs.FileSystem.from_uri(f"{folder}/{doc_id}/{kinds[doc_id % 4]}")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(text.encode())
            yield frame[["doc_id"]]

    docs.mapInPandas(write, "doc_id long").count()
    return uploads(spark, folder, "*.{txt,md}").select(
        "filename", "length", F.sha2("content", 256).alias("sha"))


def _pages_of_file(frame: pd.DataFrame) -> pd.DataFrame:
    """A decoder for the checks: the lines after the mark of a page file are its pages."""
    pages = bytes(frame["content"][0])[4:].decode().split("\n")
    return pd.DataFrame({
        "content": pages, "source": frame["filename"][0], "page_number": range(1, len(pages) + 1),
        "section": None, "metadata": [{"format": "pdf", "total_pages": str(len(pages))}] * len(pages)})


def ingest_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Files, files that became documents, and dead letters, per type: no file is lost."""
    decoders = intake.Decoders()
    decoders.register(magic.PDF, _pages_of_file)
    files = _files(spark, sf).withColumn("upload_id", F.xxhash64("filename", "content"))
    ready = prepare(files, limit=UPLOAD_LIMIT, decoders=decoders)
    typed = intake.with_type(intake.guard_size(files, UPLOAD_LIMIT)).select("upload_id", "mime")
    documents = ready.sources.select("upload_id").join(typed.distinct(), "upload_id").select(
        "mime", F.lit("documents").alias("kind"))
    counted = typed.select("mime", F.lit("files").alias("kind")).unionByName(
        ready.dead_letters.select("mime", F.lit("dead").alias("kind"))).unionByName(documents).groupBy("mime")
    return counted.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("files", "dead", "documents")])


def ingest_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that ``prepare`` hands on, and how many raw files share each name."""
    decoders = intake.Decoders()
    decoders.register(magic.PDF, _pages_of_file)
    ready = prepare(_files(spark, sf), limit=UPLOAD_LIMIT, decoders=decoders)
    return ready.sources.groupBy("source").agg(F.count("*").alias("files"))


def parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    parsed = intake.parse_text_files(_typed(spark, sf))
    return intake.dead_letters(parsed).select("filename", "length", "mime", "reason")


def intake_disposition(spark: SparkSession, sf: str) -> DataFrame:
    parsed = intake.parse_text_files(_typed(spark, sf))
    return parsed.groupBy(
        intake.disposition(F.col("reason")).cast("long").alias("status")
    ).agg(F.count("*").alias("files"))


QUERIES = {
    f.__name__: f
    for f in (mime_tricky, strip_markdown, markdown_code, decode_replacing, scanned_files, ingest_balance, ingest_sources, decode_text, detect_mime, supported_split, strip_markup, page_rows, section_split,
              parse_errors, intake_disposition)
}

# The marks that the derived files can carry, written out for the check.
_MARKS = """WHEN head LIKE '25504446%' THEN 'application/pdf'
         WHEN head LIKE '504B0304%' THEN 'application/zip'
         WHEN head LIKE '4D5A%' THEN 'application/x-msdownload'
         WHEN head LIKE '2321414D52%' THEN 'audio/amr' WHEN head LIKE '2521%' THEN 'application/postscript'
         WHEN head LIKE '424D%' THEN 'image/bmp' WHEN head LIKE '474946%' THEN 'image/gif'
         WHEN head LIKE '494433%' THEN 'audio/mpeg' WHEN head LIKE '435753%' THEN 'application/x-shockwave-flash'"""
_WORD_ENTRY = "'(?s)PK\\x03\\x04.{26}word/'"
_TYPED = f"""{D.RAW_FILES}, typed AS (
  SELECT filename, content, CAST(strlen(content) AS BIGINT) AS length,
    CASE WHEN substr(head, 1, 8) = '504B0304' AND regexp_matches(content, {_WORD_ENTRY})
         THEN '{magic.DOCX}' {_MARKS}
         WHEN regexp_matches(lower(filename), '\\.(md|markdown|mdx)$') THEN 'text/markdown'
         ELSE 'text/plain' END AS mime
  FROM (SELECT *, hex(encode(substr(content, 1, 300))) AS head FROM raw_files)
), judged AS (
  SELECT filename, content, length, mime,
    CASE WHEN length > {UPLOAD_LIMIT} THEN 'too_large'
         WHEN mime NOT IN ({', '.join(repr(m) for m in magic.SUPPORTED)}) THEN 'unsupported_type'
         WHEN mime IN ('{magic.PDF}', '{magic.DOCX}') THEN 'no decoder for this type'
         WHEN mime = 'text/markdown' AND {sql_strip('content')} = ''
         THEN '{intake.EMPTY_MARKDOWN}'
         WHEN mime = 'text/plain' AND {sql_strip('content')} = ''
         THEN '{intake.EMPTY_TEXT}' END AS reason
  FROM typed
)"""

_BALANCED = f"""{_TYPED}, balanced AS (
  SELECT filename, mime, CASE WHEN reason = 'no decoder for this type' AND mime = '{magic.PDF}'
    THEN CASE WHEN {sql_strip('substr(content, 5)')} = '' THEN 'no pages' END ELSE reason END AS reason
  FROM judged
)"""

ORACLE = {
    "mime_tricky": f"""SELECT doc_id, CASE doc_id % {len(TRICKY)} WHEN 4 THEN 'image/webp' WHEN 5 THEN 'audio/x-wav'
       WHEN 6 THEN 'video/mp4' WHEN 7 THEN 'application/zip' WHEN 8 THEN '{magic.DOCX}'
       ELSE 'text/plain' END AS mime FROM documents""",
    "strip_markdown": f"""WITH t AS (
  SELECT doc_id, {sql_strip(r"""regexp_replace('Title ' || doc_id || chr(10) || chr(10) || chr(10) || 'bold ' || doc_id
    || ' and link with Tom &amp; "Jerry" 1 &lt; 2' || chr(10) || chr(10) || 'item' || chr(10) || chr(10)
    || regexp_replace(text, '[^\p{L}\p{N} .,\n]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')""")} AS plain FROM documents)
SELECT doc_id, length(plain) AS chars, sha256(plain) AS sha FROM t""",
    "decode_replacing": """SELECT doc_id, sha256(chr(65533) || text || chr(65533) || doc_id || chr(65533)) AS sha FROM documents""",
    "scanned_files": """SELECT doc_id || CASE doc_id % 4 WHEN 0 THEN '/a/x.txt' ELSE '/a/b/y.md' END AS filename,
  strlen(text) AS length, sha256(text) AS sha FROM documents WHERE doc_id % 4 < 2""",
    "markdown_code": r"""WITH t AS (
  SELECT doc_id, 'Code' || chr(10) || chr(10) || 'see __x' || doc_id || '__ here' || chr(10) || chr(10) || '# __x' || doc_id
    || '__ &lt;*p&gt; **kw' || chr(10) || '- ' || regexp_replace(text, '[`~&<>]', '', 'g') || chr(10) || chr(10)
    || 'after x' || doc_id AS plain FROM documents)
SELECT doc_id, length(plain) AS chars, sha256(plain) AS sha FROM t""",
    "ingest_balance": f"""WITH {_BALANCED}
SELECT mime, count(*) AS files, count(reason) AS dead, count(*) - count(reason) AS documents
FROM balanced GROUP BY mime""",
    "ingest_sources": f"""WITH {_BALANCED}
SELECT filename AS source, count(*) AS files FROM balanced WHERE reason IS NULL GROUP BY filename""",
    "decode_text": f"""WITH t AS (
  SELECT doc_id, {sql_strip(r"CASE WHEN doc_id % 2 = 1 THEN regexp_replace(text, '[^\x{0}-\x{ff}]', '?', 'g') ELSE text END")} AS text
  FROM documents)
SELECT doc_id, length(text) AS chars, sha256(text) AS sha FROM t""",
    "detect_mime": f"WITH {_TYPED} SELECT filename, length, mime FROM typed",
    "supported_split": f"""WITH {_TYPED}
SELECT mime, CASE WHEN mime IN ({', '.join(repr(m) for m in magic.SUPPORTED)})
       THEN 'supported' ELSE 'unsupported_type' END AS state, count(*) AS files
FROM typed GROUP BY 1, 2""",
    "strip_markup": f"""WITH t AS (
  SELECT page_id, {sql_strip(r"regexp_replace(regexp_replace(regexp_replace(html, '(?i)</(p|h[1-6]|li|blockquote|pre|div)>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS text
  FROM pages)
SELECT page_id, length(text) AS chars, sha256(text) AS sha FROM t""",
    "page_rows": f"""WITH p AS (
  SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents
), r AS (
  SELECT doc_id, len(pages) AS total, unnest(pages) AS page,
         unnest(range(1, len(pages) + 1)) AS page_number FROM p
)
SELECT CAST(doc_id AS VARCHAR) AS source, page_number, sha256({sql_strip('page')}) AS sha,
       CAST(total AS VARCHAR) AS total_pages
FROM r WHERE {sql_strip('page')} <> ''""",
    "section_split": f"""WITH m AS (
  SELECT conv_id, turn, role = 'user' AS heading, {sql_strip('text')} AS text FROM conversations
), n AS (
  SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END)
         OVER (PARTITION BY conv_id ORDER BY turn) AS section_no FROM m
), s AS (
  SELECT conv_id, section_no,
    max(CASE WHEN heading THEN CASE WHEN text = '' THEN 'Heading 1' ELSE text END END) AS section,
    string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE NOT heading AND text <> '') AS content
  FROM n GROUP BY conv_id, section_no
)
SELECT CAST(conv_id AS VARCHAR) AS source, CAST(section_no AS BIGINT) AS section_no, section,
       sha256({sql_strip('content')}) AS sha
FROM s WHERE {sql_strip('content')} <> ''""",
    "parse_errors": f"""WITH {_TYPED}
SELECT filename, length, mime, reason FROM judged WHERE reason IS NOT NULL""",
    "intake_disposition": f"""WITH {_TYPED}
SELECT CAST(CASE WHEN reason = 'too_large' THEN 413 WHEN reason IN ('unsupported_type', 'no decoder for this type') THEN 415
       WHEN reason IS NOT NULL THEN 400 ELSE 201 END AS BIGINT) AS status, count(*) AS files
FROM judged GROUP BY 1""",
}
