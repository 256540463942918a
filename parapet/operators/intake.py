"""From files to raw documents: size guard, type detection, decoding, parsing.

A file that cannot be used keeps its row, with a ``reason``; nothing is dropped silently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions import magic, text as T
from parapet.functions.once import bind, computed
from parapet.operators.ordered import running_total

MAX_FILE_BYTES = 50 * 1024 * 1024
UNKNOWN_NAME = "unknown"

# ---- fixed values: reasons ----
TOO_LARGE = "too_large"
UNSUPPORTED = "unsupported_type"
NOT_UTF8 = "not valid UTF-8"
EMPTY_TEXT = "file is empty after stripping whitespace"
EMPTY_MARKDOWN = "no readable content after markdown stripping"
NO_PAGE_TEXT = "no extractable text found"
NO_SECTION_TEXT = "no readable text found in document"
# ---- end of fixed values ----
NO_DECODER = "no decoder for this type"
DECODER_FAILED = "decoder failed: "
NO_TEXT = {magic.PDF: NO_PAGE_TEXT, magic.DOCX: NO_SECTION_TEXT}


#: Decoded documents, and bytes of their files, that a task holds at once.
PIECE_DOCUMENTS, PIECE_BYTES = 10_000, 4 << 20

TEXT_TYPES = (magic.PLAIN, magic.MARKDOWN, "text/x-markdown")


def file_rows(df: DataFrame, filename: Column, content: Column, declared: Column) -> DataFrame:
    """``filename, content, length, declared_mime`` from any table with binary content."""
    return df.select(
        F.coalesce(F.nullif(filename, F.lit("")), F.lit(UNKNOWN_NAME)).alias("filename"),
        content.alias("content"),
        F.octet_length(content).cast("long").alias("length"),
        declared.alias("declared_mime"),
    )


def guard_size(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Add ``reason``; a file of exactly the limit passes."""
    return files.withColumn("reason", F.when(F.col("length") > limit, TOO_LARGE))


def with_type(files: DataFrame, supported: tuple[str, ...] = magic.SUPPORTED) -> DataFrame:
    """Add the detected ``mime``; a type without a parser becomes the ``reason``."""
    typed = computed(files, mime=magic.detect_mime(F.col("content"), F.col("filename")))
    return typed.withColumn(
        "reason",
        F.coalesce("reason", F.when(~F.col("mime").isin(list(supported)), UNSUPPORTED)),
    )


def valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def decode_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are not valid UTF-8; stripped."""
    utf8 = content.cast("string")
    return T.strip(
        F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))
    )


def decode_replacing(content: Column) -> Column:
    """UTF-8 with replacement characters for invalid bytes."""
    return F.make_valid_utf8(content.cast("string"))


def strip_markup(html: Column) -> Column:
    """Closing block tags become newlines, other tags vanish, blank lines are limited."""
    # fixed values: the tags that end a line, and what counts as a tag
    text = F.regexp_replace(html, r"(?i)</(p|h[1-6]|li|blockquote|pre|div)>", "\n")
    text = F.regexp_replace(text, r"<[^>\x{fdd0}\x{fdd1}]+>", "")
    return T.strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


#: Characters that no text holds; they stand for code while the other rules run.
_FENCED, _INLINE = "\ufdd1", "\ufdd0"
_FENCE = r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n(.*?)(?:^ {0,3}\1[`~]* *$|\z)"
_CODE = r"(`+)(?!`)(.+?)(?<!`)\1(?!`)"


def _put_back(text: Column, mark: str, code: Column) -> Column:
    """The text with the pieces of code where their marks stand, escaped like a renderer does."""
    def written(code: Column) -> Column:
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            code = F.replace(code, F.lit(char), F.lit(entity))
        return code

    return F.array_join(F.zip_with(
        F.split(text, mark, -1), code, lambda gap, c: F.concat(gap, F.coalesce(written(c), F.lit("")))), "")


def strip_markdown(text: Column) -> Column:
    """Plain prose of a markdown text.

    Covers headings, emphasis, code, links, images, lists, quotes and rules; anything
    rarer stays as written. HTML tags inside the text go through ``strip_markup``; other
    ``& <`` come out as entities, as a renderer writes them and a tag stripper leaves them.
    Code in fences and between backticks keeps every sign, with ``& < >`` as entities.
    """
    clean = F.translate(text, _FENCED + _INLINE, "")

    def without_fences(clean: Column) -> Column:
        masked = F.regexp_replace(clean, _FENCE, _FENCED)
        return bind(masked, lambda rest: _put_back(_put_back(
            _prose(F.regexp_replace(rest, _CODE, _INLINE)), _INLINE, F.regexp_extract_all(rest, F.lit(_CODE), F.lit(2))),
            _FENCED, F.regexp_extract_all(clean, F.lit(_FENCE), F.lit(2))))

    coded = text.contains("`") | text.contains("~~~")
    return F.when(coded, T.strip(bind(clean, without_fences))).otherwise(_prose(text))


def _prose(text: Column) -> Column:
    text = F.regexp_replace(text, r"&(?!#?\w+;)", "&amp;")
    text = F.regexp_replace(text, r"<(?!/?[A-Za-z!?])", "&lt;")
    for pattern, replacement in (
        (rf"!\[[^\]{_INLINE}]*\]\([^){_INLINE}]*\)", ""),
        (rf"\[([^\]]*)\]\([^){_INLINE}]*\)", "$1"),
        (r"(?m)^ {0,3}([-*_])( *\1){2,} *$", ""),
        (r"(?m)^ {0,3}#{1,6} +(.*?)(?: +#+)? *$", "$1\n"),
        (r"(?m)^ {0,3}> ?", ""),
        (r"(?m)^ *(?:[-*+]|\d{1,9}[.)]) +", ""),
        (r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2"),
        (r"(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*(?![\w*])", "$1"),
        (r"(?<!\w)_(?=\S)([^_\n]+?)(?<=\S)_(?!\w)", "$1"),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return strip_markup(text)


def parse_text_files(files: DataFrame, decoded: Sequence[str] = ()) -> DataFrame:
    """Text of plain and markdown files as ``parsed``; a failed parse sets ``reason``.

    Other supported types need a decoder: those outside ``decoded`` get ``NO_DECODER``.
    """
    content, usable = F.col("content"), F.col("reason").isNull()
    markdown = F.col("mime").isin(*TEXT_TYPES[1:])
    parsed = computed(
        files,
        _valid=valid_utf8(content),
        parsed=F.when(
            usable & markdown & valid_utf8(content), strip_markdown(content.cast("string"))
        ).when(usable & (F.col("mime") == magic.PLAIN), decode_text(content)),
    )
    return parsed.withColumn(
        "reason",
        F.coalesce(
            "reason",
            F.when(~F.col("mime").isin(*TEXT_TYPES, *decoded), NO_DECODER),
            F.when(markdown & ~F.col("_valid"), NOT_UTF8)
            .when(markdown & (F.col("parsed") == ""), EMPTY_MARKDOWN)
            .when(F.col("parsed") == "", EMPTY_TEXT),
        ),
    ).drop("_valid")


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNull()).drop("reason")


def dead_letters(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNotNull())


def disposition(reason: Column) -> Column:
    """Response status of an upload: 413, 415, 400 for an unreadable file, else 201."""
    return (
        F.when(reason == TOO_LARGE, 413)
        .when(reason.isin(UNSUPPORTED, NO_DECODER), 415)
        .when(reason.isNotNull(), 400)
        .otherwise(201)
    )


def _first_pages(pages: str, limit: int | None) -> Column:
    return F.col(pages) if limit is None else F.slice(pages, 1, limit)


def page_rows(df: DataFrame, source: str, pages: str, limit: int | None = None) -> DataFrame:
    """One raw document per non-blank page of an array column, numbered from 1.

    With a ``limit`` the pages beyond it are left out; ``pages_left_out`` tells of them.
    """
    numbered = df.select(
        F.col(source).alias("source"),
        F.size(pages).alias("_total"),
        F.posexplode_outer(_first_pages(pages, limit)).alias("_pos", "_page"),
    )
    return (
        numbered.where(F.col("_page").isNotNull())
        .withColumn("content", T.strip(F.col("_page")))
        .where(F.col("content") != "")
        .select(
            "content", "source",
            (F.col("_pos") + 1).alias("page_number"),
            F.lit(None).cast("string").alias("section"),
            F.create_map(
                F.lit("total_pages"), F.col("_total").cast("string"),
                F.lit("format"), F.lit("pdf"),
            ).alias("metadata"),
        )
    )


def pages_left_out(df: DataFrame, source: str, pages: str, limit: int) -> DataFrame:
    """Files with more pages than the limit, and how many pages were not read."""
    beyond = F.size(pages) - F.lit(limit)
    return df.where(beyond > 0).select(
        F.col(source).alias("source"),
        F.format_string("%d of %d pages beyond the limit", beyond, F.size(pages)).alias("reason"),
    )


def files_without_pages(df: DataFrame, source: str, pages: str, limit: int | None = None) -> DataFrame:
    """Files in whose pages no text was found, with the reason; null pages are none."""
    texts = F.filter(_first_pages(pages, limit), lambda page: T.strip(page) != "")
    return df.where(F.coalesce(F.size(texts), F.lit(0)) <= 0).select(
        F.col(source).alias("source"), F.lit(NO_PAGE_TEXT).alias("reason")
    )


def section_rows(paragraphs: DataFrame, slice_rows: int = 4096) -> DataFrame:
    """Raw documents cut at headings from rows of ``source, pos, style, text``.

    A heading row closes the section before it and names the rows that follow; a blank
    heading lends its style name. The section number is a running count over slices of
    ``slice_rows`` paragraphs, and the text is joined per slice first, so no task has to
    hold the paragraphs of a whole long document one by one.
    """
    text = T.strip(F.coalesce(F.col("text"), F.lit("")))
    marked = paragraphs.select(
        "source", F.col("pos").cast("long").alias("pos"),
        F.floor(F.col("pos") / slice_rows).alias("_slice"),
        F.coalesce(F.col("style").startswith("Heading"), F.lit(False)).alias("_heading"),
        text.alias("_text"),
        F.when(text == "", F.col("style")).otherwise(text).alias("_title"),
    )
    numbered = running_total(
        marked, ["source"], "_slice", ["pos"], F.col("_heading").cast("long"), "_section"
    )
    line = F.when(~F.col("_heading") & (F.col("_text") != ""), F.struct("pos", F.col("_text")))
    parts = numbered.groupBy("source", "_section", "_slice").agg(
        F.array_sort(F.collect_list(line)).alias("_lines"),
        F.max(F.when(F.col("_heading"), F.col("_title"))).alias("_title"),
    ).select(
        "source", "_section", "_title",
        F.when(
            F.size("_lines") > 0,
            F.struct(
                "_slice", F.array_join(F.col("_lines._text"), "\n").alias("_text")
            ),
        ).alias("_part"),
    )
    sections = parts.groupBy("source", "_section").agg(
        F.array_sort(F.collect_list("_part")).alias("_parts"), F.max("_title").alias("section")
    )
    whole = sections.withColumn("content", T.strip(F.array_join(F.col("_parts._text"), "\n")))
    described = F.map_filter(
        F.create_map(F.lit("format"), F.lit("docx"), F.lit("section"), F.col("section")),
        lambda _, value: value.isNotNull(),
    )
    return whole.where(F.col("content") != "").select(
        "content", "source", F.lit(None).cast("int").alias("page_number"), "section",
        described.alias("metadata"), F.col("_section").alias("section_no"),
    )


def files_without_sections(paragraphs: DataFrame) -> DataFrame:
    """Files whose paragraphs hold no text outside headings, with the reason."""
    heading = F.coalesce(F.col("style").startswith("Heading"), F.lit(False))
    body = ~heading & (T.strip(F.coalesce(F.col("text"), F.lit(""))) != "")
    return paragraphs.groupBy("source").agg(F.bool_or(body).alias("_any")).where(
        ~F.col("_any")
    ).select("source", F.lit(NO_SECTION_TEXT).alias("reason"))


class Decoders:
    """User functions that turn the files of one type into raw documents.

    A function gets ``filename, content`` as a pandas frame of one file and gives rows of
    ``content, source, page_number, section, metadata``; one file may yield many rows. A
    function that raises costs its own file only: the file becomes a dead letter.
    """

    SCHEMA = (
        "content string, source string, page_number int, section string, "
        "metadata map<string,string>"
    )

    def __init__(self) -> None:
        self._by_mime: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}

    def register(self, mime: str, decode: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
        self._by_mime[mime] = decode

    def types(self) -> list[str]:
        return sorted(self._by_mime)

    def supported(self) -> list[str]:
        return sorted({*magic.SUPPORTED, *self._by_mime})

    def decoded(self, files: DataFrame) -> DataFrame:
        """The files of all registered types with ``documents``, an array of raw documents
        without blank ones, and ``problem``, the error of a function that raised."""
        by_mime = dict(self._by_mime)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield from _in_pieces(frame, lambda row: decode(by_mime[row.mime], row))

        def decode(function: Callable, row) -> tuple[list[tuple], str | None]:
            one = pd.DataFrame({"filename": [row.filename], "content": [row.content]})
            try:
                found = function(one).to_dict("records")
            except Exception as error:  # a user function: its file is reported
                return [], f"{type(error).__name__}: {error}"
            return [_document(d) for d in found], None

        kept = [f for f in files.columns if f != "content"]
        fields = ", ".join(f"{f} {files.schema[f].dataType.simpleString()}" for f in kept)
        shape = self.SCHEMA.replace(" string", ":string").replace(" int", ":int").replace(" map", ":map")
        rows = files.where(F.col("mime").isin(self.types())).select(*kept, "content").mapInPandas(
            run, f"{fields}, documents array<struct<{shape}>>, problem string")
        filled = F.filter("documents", lambda d: T.strip(F.coalesce(d["content"], F.lit(""))) != "")
        return rows.withColumn("documents", filled)


def _in_pieces(frame: pd.DataFrame, decode: Callable) -> Iterator[pd.DataFrame]:
    """The files with what ``decode`` makes of them. Many small documents take several times
    the room of their file, so a piece is given away as soon as it holds ``PIECE_DOCUMENTS``
    of them or files of ``PIECE_BYTES``; a single file stays whole."""
    kept = frame.drop(columns="content")
    start, documents, problems, held, size = 0, [], [], 0, 0
    for at, row in enumerate(frame.itertuples(index=False), 1):
        found, problem = decode(row)
        documents.append(found)
        problems.append(problem)
        held, size = held + len(found), size + len(row.content)
        if held >= PIECE_DOCUMENTS or size >= PIECE_BYTES or at == len(frame):
            yield kept.iloc[start:at].assign(documents=documents, problem=problems)
            start, documents, problems, held, size = at, [], [], 0, 0


def _document(row: dict) -> tuple:
    """A raw document as the schema wants it; pandas' missing values become null."""
    def plain(value):
        return None if value is None or value is pd.NA or value != value else value

    number = plain(row.get("page_number"))
    metadata = plain(row.get("metadata")) or {}
    return (plain(row.get("content")), plain(row.get("source")), None if number is None else int(number),
            plain(row.get("section")), {str(k): None if v is None else str(v) for k, v in metadata.items()})
