import pandas as pd
import pytest
from pyspark.sql import functions as F

from parapet.functions import magic
from parapet.operators import intake as I
from parapet.plans.ingest import ingest, prepare
from parapet.sources.files import scan_files, small_uploads, uploads

FILES = "filename string, content binary"


def typed(spark, *files, limit=I.MAX_FILE_BYTES):
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in files], FILES)
    rows = I.file_rows(df, F.col("filename"), F.col("content"), F.lit("image/png"))
    return I.with_type(I.guard_size(rows, limit))


def test_types_ignore_the_declared_one(spark):
    cases = {
        ("a.txt", b"%PDF-1.7"): magic.PDF,
        ("a.md", b"PK\x03\x04" + b"\x00" * 26 + b"[Content_Types].xml" + b"x" * 9000
         + b"PK\x03\x04" + b"\x00" * 26 + b"word/document.xml"): magic.DOCX,
        ("z.md", b"PK\x03\x04" + b"\x00" * 26 + b"password/a.txt"): "application/zip",
        ("w.txt", b"Convert WEBP to png"): magic.PLAIN, ("f.txt", b"The ftyp box"): magic.PLAIN,
        ("v.txt", b"All the WAVE files"): magic.PLAIN,
        ("a.md", b"PK\x03\x04other"): "application/zip",
        ("x.txt", b"MZ\x90"): "application/x-msdownload",
        ("x.png", b"\x89PNG\r\n"): "image/png",
        ("x.webp", b"RIFF1234WEBP"): "image/webp",
        ("README.MD", b"# Title"): magic.MARKDOWN,
        ("a.mdx", b"text"): magic.MARKDOWN,
        ("noext", b"text"): magic.PLAIN,
        ("e.txt", b""): magic.PLAIN,
    }
    got = [r.mime for r in typed(spark, *cases).collect()]
    assert got == list(cases.values())


def test_reasons_and_status(spark):
    rows = I.parse_text_files(typed(
        spark, ("ok.txt", b" text "), ("big.txt", b"x" * 21), ("x.exe", b"MZ..."),
        ("blank.txt", b" \n "), ("blank.md", b"\n"), ("bad.md", b"\xff\xfe"), ("", b"text"),
        ("latin.txt", "café".encode("latin-1")), limit=20,
    )).withColumn("status", I.disposition(F.col("reason"))).collect()
    assert [r.reason for r in rows] == [
        None, I.TOO_LARGE, I.UNSUPPORTED, I.EMPTY_TEXT, I.EMPTY_MARKDOWN, I.NOT_UTF8, None, None
    ]
    assert [r.status for r in rows] == [201, 413, 415, 400, 400, 400, 201, 201]
    assert rows[0].parsed == "text" and rows[6].filename == "unknown" and rows[7].parsed == "café"


def test_markdown(spark):
    text = ("# Title #\n\nSome **bold** and *soft* `code` with a [link](http://x) and "
            "![pic](y.png).\n\n- one\n- two\n\n> quote\n\n```py\nx = 1\n```\n<div>html</div>a_b_c")
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(I.strip_markdown(F.col("t")).alias("m")).first().m
    assert got == ("Title\n\nSome bold and soft code with a link and .\n\none\ntwo\n\nquote\n\n"
                   "x = 1\n\nhtml\na_b_c")


def test_markdown_code_stays(spark):
    text = ("# Top\n\n**Use `__init__` and `*p`** and `a & <b>` *now*\n\n```py\ndef __init__(self, *p, **kw):\n"
            "    # no heading\n- no item <br> & [no](link)\n\n\n\n> x\n```\nafter `` ` `` __end__\n~~~\nopen _fence_")
    df = spark.createDataFrame([(text,), ("`open *soft*",), ("a\ufdd0b `c`",)], "t string")
    got = [r.m for r in df.select(I.strip_markdown(F.col("t")).alias("m")).collect()]
    assert got[0] == (
        "Top\n\nUse __init__ and *p and a &amp; &lt;b&gt; now\n\ndef __init__(self, *p, **kw):\n    # no heading\n"
        "- no item &lt;br&gt; &amp; [no](link)\n\n\n\n&gt; x\n\nafter  `  end\nopen _fence_")
    assert got[1:] == ["`open soft", "ab c"]


def test_markup_keeps_entities(spark):
    df = spark.createDataFrame([("<h1>A</h1><p>b &amp; c</p>\n\n\n<i>d</i>",)], "t string")
    assert df.select(I.strip_markup(F.col("t")).alias("m")).first().m == "A\nb &amp; c\n\nd"


def test_replacement_characters(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "c binary")
    assert df.select(I.decode_replacing(F.col("c")).alias("t")).first().t == "a�b"


def test_pages(spark):
    df = spark.createDataFrame([("a.pdf", ["one", "  ", "three"] + ["x"] * 1000), ("b.pdf", [" "])],
                               "f string, pages array<string>")
    rows = I.page_rows(df, "f", "pages").orderBy("page_number").collect()
    assert [r.page_number for r in rows][:3] == [1, 3, 4] and rows[-1].page_number == 1003
    cut = I.page_rows(df, "f", "pages", 1000).agg(F.max("page_number")).first()[0]
    left = [tuple(r) for r in I.pages_left_out(df, "f", "pages", 1000).collect()]
    assert cut == 1000 and left == [("a.pdf", "3 of 1003 pages beyond the limit")]
    assert rows[0].metadata == {"total_pages": "1003", "format": "pdf"}
    assert [r.source for r in I.files_without_pages(df, "f", "pages").collect()] == ["b.pdf"]


@pytest.mark.parametrize("slice_rows", [2, 4096])
def test_sections(spark, slice_rows):
    rows = [(0, "Normal", "intro"), (1, "Heading 1", " One "), (2, "Normal", "a"), (3, None, " "),
            (4, "Normal", "b"), (5, "Normal", "c"), (6, "Heading 2", ""), (7, "Normal", "d"),
            (8, "Heading 1", "Empty")]
    df = spark.createDataFrame([("f", *r) for r in rows],
                               "source string, pos int, style string, text string")
    got = I.section_rows(df, slice_rows).orderBy("section_no").collect()
    assert [(r.section, r.content) for r in got] == [
        (None, "intro"), ("One", "a\nb\nc"), ("Heading 2", "d")
    ]
    assert got[0].metadata == {"format": "docx"}
    assert got[1].metadata == {"format": "docx", "section": "One"}


def test_files_without_sections(spark):
    df = spark.createDataFrame(
        [("a", "Heading 1", "Only a title"), ("a", "Normal", " "), ("b", "Normal", "text")],
        "source string, style string, text string")
    assert [tuple(r) for r in I.files_without_sections(df).collect()] == [("a", I.NO_SECTION_TEXT)]


def test_own_decoder(spark):
    decoders = I.Decoders()

    def shout(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.loc[frame.index.repeat(2)]
        return pd.DataFrame({
            "content": [bytes(c).decode().upper() for c in frame["content"]],
            "source": frame["filename"].tolist(), "page_number": [1, 2] * (len(frame) // 2),
            "section": None, "metadata": [{"format": "own"}] * len(frame),
        })

    decoders.register("application/x-own", shout)
    files = spark.createDataFrame([("a", bytearray(b"hi"), "application/x-own")],
                                  "filename string, content binary, mime string")
    rows = decoders.decoded(files).first().documents
    assert [(r.content, r.page_number) for r in rows] == [("HI", 1), ("HI", 2)]
    assert "application/x-own" in decoders.supported()


def test_folder_scan_and_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("A sentence that repeats itself. " * 40)
    (tmp_path / "sub" / "b.md").write_text("# Head\n\nThe marker zebra-quartz is in this file, **bold**.")
    (tmp_path / "c.TXT").write_text("not read by the suffix match")
    (tmp_path / "d.bin").write_bytes(b"MZ\x00")
    assert scan_files(spark, str(tmp_path)).count() == 2
    names = {r.filename for r in uploads(spark, str(tmp_path)).collect()}
    assert names == {"a.txt", "sub/b.md", "c.TXT", "d.bin"}
    small, large = small_uploads(spark, str(tmp_path), 10)
    assert small.count() == 1 and {r.reason for r in large.collect()} == {I.TOO_LARGE}
    assert small.count() + large.count() == 4
    none = spark.createDataFrame([], "chunk_id string")
    fresh, summary, dead = ingest(uploads(spark, str(tmp_path)), none, "notes")
    assert [r.reason for r in dead.collect()] == [I.UNSUPPORTED]
    created = {r.source: r.chunks_created for r in summary.collect()}
    assert created["a.txt"] > 1 and created["sub/b.md"] == 1
    text = fresh.where("source = 'sub/b.md'").first()
    assert "zebra-quartz" in text.content and "**" not in text.content
    assert text.metadata["format"] == "markdown" and text.collection == "notes"
    again, second, _ = ingest(uploads(spark, str(tmp_path)), fresh)
    assert again.count() == 0
    assert {r.source: r.duplicates_skipped for r in second.collect()} == created


def test_default_collection_spec(spark):
    ready = prepare(typed(spark, ("a.txt", b"x")).drop("mime", "reason"))
    assert ready.chunks.count() == 1 and ready.dead_letters.count() == 0


def test_no_upload_vanishes(spark):
    def pages(frame):
        body = bytes(frame["content"][0])
        if b"broken" in body:
            raise ValueError("broken file")
        texts = body[4:].decode().split("|")
        return pd.DataFrame({"content": texts, "source": frame["filename"][0],
                             "page_number": range(1, len(texts) + 1), "section": None,
                             "metadata": [{"format": "pdf"}] * len(texts)})

    word = b"PK\x03\x04" + b"\x00" * 26 + b"word/document.xml"
    files = typed(spark, ("a.pdf", b"%PDFpage one text|page two text"), ("b.pdf", b"%PDFbroken"),
                  ("c.pdf", b"%PDF | "), ("d.docx", word), ("e.txt", b"plain"), ("f.exe", b"MZ"),
                  ("g.txt", b" ")).drop("mime", "reason")
    decoders = I.Decoders()
    decoders.register(magic.PDF, pages)
    ready = prepare(files, decoders=decoders)
    dead = {r.filename: r.reason for r in ready.dead_letters.collect()}
    assert dead == {"b.pdf": "decoder failed: ValueError: broken file", "c.pdf": I.NO_PAGE_TEXT,
                    "d.docx": I.NO_DECODER, "f.exe": I.UNSUPPORTED, "g.txt": I.EMPTY_TEXT}
    chunked = {(r.source, r.metadata.get("page")) for r in ready.chunks.collect()}
    assert chunked == {("a.pdf", "1"), ("a.pdf", "2"), ("e.txt", None)}
    assert {r.source for r in ready.sources.collect()} == {"a.pdf", "e.txt"}
    assert {r.filename for r in prepare(files).dead_letters.collect()} == {
        "a.pdf", "b.pdf", "c.pdf", "d.docx", "f.exe", "g.txt"}


def test_uploads_of_one_name_are_told_apart(spark):
    files = typed(spark, ("", b"first text"), ("", b"second text"), ("", b"second text")).drop("mime", "reason")
    none = spark.createDataFrame([], "chunk_id string")
    _, summary, _ = ingest(files, none)
    rows = summary.select("source", "chunks_created").collect()
    assert sorted(tuple(r) for r in rows) == [("unknown", 1), ("unknown", 2)]


def test_decoded_files_leave_a_task_in_pieces(spark, monkeypatch):
    """A batch of files is not held whole: pieces of bounded size, each file once, in order."""
    import numpy as np

    monkeypatch.setattr(I, "PIECE_DOCUMENTS", 5)
    monkeypatch.setattr(I, "PIECE_BYTES", 40)
    frame = pd.DataFrame({"filename": [f"f{i}" for i in range(9)], "content": [b"x" * 8] * 7 + [b"y" * 100, b""]})
    many = {"f2": 50}
    pieces = list(I._in_pieces(frame, lambda row: ([row.filename] * many.get(row.filename, 1), None)))
    assert list(np.concatenate([p["filename"] for p in pieces])) == list(frame["filename"])
    assert [len(p) for p in pieces] == [3, 4 + 1, 1] or max(len(p) for p in pieces) <= 5
    assert [len(p["documents"].iloc[0]) for p in pieces][0] == 1 and not list(I._in_pieces(frame[:0], None))
    decoders = I.Decoders()
    decoders.register("a/b", lambda f: pd.DataFrame({"content": [f["filename"][0]] * 3, "source": "s"}))
    files = spark.createDataFrame([(f"n{i}", bytearray(b"z"), "a/b") for i in range(23)],
                                  "filename string, content binary, mime string").coalesce(1)
    rows = decoders.decoded(files).collect()
    assert {r.filename: [d.content for d in r.documents] for r in rows} == {f"n{i}": [f"n{i}"] * 3 for i in range(23)}
    assert len(rows) == 23


def test_listing_stays_off_the_driver(spark, tmp_path):
    """Spark's reader for whole files, which lists on the driver, is not used, and the rows
    are those it gives: nested folders, hidden names, odd names, patterns, empty files."""
    for name, body in {"a b/c%20d/é.txt": "one", "a b/x.md": "", "_x/y.txt": "hidden", ".z.txt": "hidden",
                       "k=1/_m=2.txt": "two", "deep/er/and/er/q.txt": "three", "n.TXT": "no", "p.txt": "q" * 5000}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "empty").mkdir()
    for pattern in ("*.{txt,md}", "*", "[n-p].*", "?.txt"):
        theirs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", pattern).load(str(tmp_path))
        ours = scan_files(spark, str(tmp_path), pattern)
        assert ours.columns == theirs.columns
        assert "binaryFile" not in ours._jdf.queryExecution().toString()
        pick = lambda df: sorted((r.path, r.length, bytes(r.content)) for r in df.collect())
        assert pick(ours) == pick(theirs), pattern
    assert {r.filename for r in uploads(spark, f"file:{tmp_path}", "q.*").collect()} == {"deep/er/and/er/q.txt"}
    assert scan_files(spark, str(tmp_path / "p.txt")).first().length == 5000
    assert scan_files(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(FileNotFoundError):
        scan_files(spark, str(tmp_path / "missing"))
