"""Splitting documents into overlapping chunks with stable ids.

Every step is a per-row expression, so chunking needs no shuffle: a document goes in,
an array of chunks comes out, and ``posexplode`` turns it into rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions import text as T
from parapet.functions.once import bind


@dataclass(frozen=True)
class ChunkSpec:
    """Sizes in characters. ``validated`` applies the limits of the request form."""

    size: int = 512
    overlap: int = 64
    minimum: int = 50

    def __post_init__(self) -> None:
        if self.overlap >= self.size:
            raise ValueError("overlap must be smaller than chunk_size")

    def validated(self) -> "ChunkSpec":
        if not 128 <= self.size <= 4096:
            raise ValueError("chunk_size must lie in 128..4096")
        if not 0 <= self.overlap <= 512:
            raise ValueError("overlap must lie in 0..512")
        return self


FOLD_BLOCK = 2_048


def _starts(lengths: Column, size: int, extra: int) -> Column:
    """Where greedy lines begin among items of some lengths, as places from 0.

    An item costs its length plus one, and opens a new line if its length plus ``extra`` does
    not fit. Only integers are folded. The fold goes over blocks of items that start with an
    empty list, which are joined once per block, so a text of many megabytes does not copy
    its list once per line.
    """
    none = F.array().cast("array<int>")
    empty = F.struct(none.alias("done"), F.lit(None).cast("int").alias("used"), F.lit(0).alias("at"))

    def step(state: Column, length: Column) -> Column:
        opens = state["used"].isNull() | (state["used"] + length + extra > size)
        return F.struct(
            F.when(opens, F.concat(state["done"], F.array(state["at"]))).otherwise(state["done"]).alias("done"),
            (F.when(opens, length).otherwise(state["used"] + length) + 1).alias("used"),
            (state["at"] + 1).alias("at"))

    def over_blocks(every: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(
            F.ceil(F.size(every) / FOLD_BLOCK).cast("int") - 1, F.lit(0)))

        def one_block(state: Column, block: Column) -> Column:
            own = F.aggregate(
                F.slice(every, block * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)),
                F.struct(none.alias("done"), state["used"].alias("used"), state["at"].alias("at")), step)
            return bind(own, lambda inner: F.struct(
                F.concat(state["done"], inner["done"]).alias("done"), inner["used"].alias("used"),
                inner["at"].alias("at")))

        return F.aggregate(blocks, empty, one_block)["done"]

    small = F.aggregate(lengths, empty, step)["done"]
    return F.when(F.size(lengths) <= FOLD_BLOCK, small).otherwise(bind(lengths, over_blocks))


def _lines(items: Column, size: int, extra: int) -> Column:
    """The items joined by blanks, line by line; each line is sliced and joined once."""

    def cut(every: Column) -> Column:
        starts = bind(F.transform(every, F.length), lambda lengths: _starts(lengths, size, extra))
        return bind(starts, lambda first: F.transform(first, lambda start, k: F.array_join(
            F.slice(every, start + 1, F.coalesce(F.get(first, k + 1), F.size(every)) - start), " ")))

    return bind(items, cut)


def pack_words(text: Column, size: int) -> Column:
    """Fill lines greedily; a word costs its length plus one, a longer word stays whole."""
    return _lines(T.words(text), size, 1)


def pack_pieces(pieces: Column, spec: ChunkSpec) -> Column:
    """Join pieces up to the chunk size and start each chunk with the end of the last body.

    The overlap is not counted into the size and comes from the body alone, never from
    an overlap that the previous chunk itself started with.
    """

    def with_lead(bodies: Column) -> Column:
        if not spec.overlap:
            return F.transform(bodies, T.strip)
        return F.transform(bodies, lambda body, k: T.strip(F.when(k == 0, body).otherwise(F.concat(
            F.right(F.get(bodies, k - 1), F.lit(spec.overlap)), F.lit(" "), body))))

    return bind(_lines(pieces, spec.size, 0), with_lead)


def pieces(text: Column, size: int) -> Column:
    """Paragraphs; sentences of a paragraph that is too long; word runs of such a sentence."""

    def by_sentence(paragraph: Column) -> Column:
        return F.flatten(
            F.transform(
                T.sentences(paragraph),
                lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(pack_words(s, size)),
            )
        )

    return F.flatten(
        F.transform(
            T.paragraphs(text),
            lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(by_sentence(p)),
        )
    )


def raw_chunks(text: Column, spec: ChunkSpec) -> Column:
    """All chunks of a text, also those below the minimum length."""
    return pack_pieces(pieces(T.collapse_whitespace(text), spec.size), spec)


def keep_chunks(chunks: Column, minimum: int) -> Column:
    """Drop short chunks, but keep the first one of a text that has only short ones."""
    kept = F.filter(chunks, lambda c: F.length(c) >= minimum)
    return F.when(F.size(kept) == 0, F.slice(chunks, 1, 1)).otherwise(kept)


def fixed_windows(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Windows of fixed width, stripped, without the empty ones."""
    starts = F.when(
        F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size - overlap))
    ).otherwise(F.array().cast("array<int>"))
    return T.non_empty(F.transform(starts, lambda s: F.substring(text, s, F.lit(size))))


def chunk_metadata(
    metadata: Column, source: Column, index: Column, page: Column, section: Column
) -> Column:
    """Document metadata overlaid by source, chunk_index, page and section.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``, as set by ``session.configure``.
    """
    own = F.create_map(
        F.lit("source"), source,
        F.lit("chunk_index"), index.cast("string"),
        F.lit("page"), page.cast("string"),
        F.lit("section"), F.nullif(section, F.lit("")),
    )
    present = F.map_filter(own, lambda _, v: v.isNotNull())
    return F.map_concat(F.coalesce(metadata, F.create_map().cast("map<string,string>")), present)


def chunk_documents(docs: DataFrame, spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """Rows of ``content, source, page_number, section, metadata`` become chunk rows.

    Further columns of the input, such as a document id, are carried along.
    """
    fixed = {"content", "source", "page_number", "section", "metadata"}
    carried = [c for c in docs.columns if c not in fixed]
    packed = docs.withColumn("raw_chunks", raw_chunks(F.col("content"), spec)).drop("content")
    kept = packed.withColumn("kept", keep_chunks(F.col("raw_chunks"), spec.minimum))
    # The outer form keeps the optimizer from deriving a filter that would chunk the text again.
    rows = kept.select(
        *carried, "source", "page_number", "section", "metadata",
        F.posexplode_outer("kept").alias("chunk_index", "content"),
    ).where(F.col("content").isNotNull())
    return rows.select(
        *carried,
        T.content_id(F.col("source"), F.col("content")).alias("chunk_id"),
        "source",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "content",
        chunk_metadata(
            F.col("metadata"), F.col("source"), F.col("chunk_index"),
            F.col("page_number"), F.col("section"),
        ).alias("metadata"),
    )


def raw_documents(
    df: DataFrame, content: Column, source: Column, metadata: Column | None = None, *carried: str
) -> DataFrame:
    """Shape any text table as chunker input."""
    return df.select(
        *carried,
        content.alias("content"),
        source.alias("source"),
        F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("string").alias("section"),
        (metadata if metadata is not None else F.create_map().cast("map<string,string>"))
        .alias("metadata"),
    )
