import hashlib

import pytest
from pyspark.sql import functions as F

from parapet.operators.chunking import ChunkSpec, chunk_documents, fixed_windows, raw_chunks
from parapet.functions import text as T

SMALL = ChunkSpec(200, 30, 20)
SCHEMA = ("content string, source string, page_number int, section string, "
          "metadata map<string,string>")


def chunks(spark, *docs, spec=SMALL):
    rows = [(d, "s.txt", 3, "Intro", {"lang": "en", "source": "x"}) if isinstance(d, str) else d
            for d in docs]
    return chunk_documents(spark.createDataFrame(rows, SCHEMA), spec).orderBy(
        "source", "chunk_index"
    ).collect()


def test_short_text_is_one_chunk(spark):
    (row,) = chunks(spark, "A short text that is long enough.")
    assert row.content == "A short text that is long enough." and row.chunk_index == 0
    assert row.chunk_id == hashlib.sha256(f"s.txt:{row.content}".encode()).hexdigest()[:32]
    assert row.metadata == {
        "lang": "en", "source": "s.txt", "chunk_index": "0", "page": "3", "section": "Intro"
    }


def test_long_text_overlaps(spark):
    text = "\n\n".join(f"Paragraph {i} has some words in it, about sixty letters." for i in range(10))
    rows = chunks(spark, text)
    assert len(rows) > 1 and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert all(len(r.content) <= 400 for r in rows)
    body = rows[0].content
    assert rows[1].content.startswith(body[-30:].strip())


def test_overlap_comes_from_the_body_only(spark):
    words = [c * 8 for c in "abcdef"]
    df = spark.createDataFrame([("\n\n".join(words),)], "t string")
    got = df.select(raw_chunks(F.col("t"), ChunkSpec(10, 9, 1)).alias("c")).first().c
    assert got == ["aaaaaaaa", "aaaaaaaa bbbbbbbb", "bbbbbbbb cccccccc", "cccccccc dddddddd",
                   "dddddddd eeeeeeee", "eeeeeeee ffffffff"]


def test_small_pieces(spark):
    assert [r.content for r in chunks(spark, "tiny")] == ["tiny"]
    assert chunks(spark, "   \n ") == []
    rows = chunks(spark, "x" * 1000)
    assert [r.content for r in rows] == ["x" * 1000]


def test_ids_depend_on_source_and_content(spark):
    docs = [("Same content in both of them.", s, None, None, None) for s in ("a", "b", "a")]
    rows = chunks(spark, *docs)
    assert len({r.chunk_id for r in rows}) == 2 and rows[0].metadata == {
        "source": "a", "chunk_index": "0"
    }


def test_whitespace_rule_comes_first(spark):
    df = spark.createDataFrame([("a\n\n\nb   c\n\nd",)], "t string")
    row = df.select(T.paragraphs(T.collapse_whitespace(F.col("t"))).alias("p")).first()
    assert row.p == ["a  b  c", "d"]


def test_sentences(spark):
    df = spark.createDataFrame([("The U.S. Army came. it left! Next\nline.",)], "t string")
    assert df.select(T.sentences(F.col("t")).alias("s")).first().s == [
        "The U.S.", "Army came. it left!", "Next", "line."
    ]


def test_spec_limits():
    with pytest.raises(ValueError):
        ChunkSpec(100, 100)
    for size, overlap in ((127, 0), (4097, 0), (2000, 513)):
        with pytest.raises(ValueError):
            ChunkSpec(size, overlap).validated()


def test_fixed_windows(spark):
    df = spark.createDataFrame([("a" * 1000,), ("",), ("  ",)], "t string")
    sizes = [[len(w) for w in r.w] for r in df.select(fixed_windows(F.col("t")).alias("w")).collect()]
    assert sizes == [[512, 512, 104], [], []]
