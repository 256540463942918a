import base64
import gzip
import hashlib
import zlib
from collections import Counter

import brute
import pytest
from brute import ODD
from parapet.llm import minimax, warc
from parapet.llm.shared import attach, open_folder
from parapet.session import shared_folder
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, shard string"
ROWS = [(1, "http://a/b c", "same", "x"), (2, None, "same", "x"), (9, "http://é", "same", "x"), (4, "u", None, "x"),
        (5, "u", "", "x"), (None, "u", "same", "x"), (None, "u", "alone", "x"), (7, "u", "two\r\n\r\nparts é", "x"),
        (8, "u", "z" * 400_000, "x"), (8, "u", "z" * 400_000, "x"), (2**40, "far", "far away", "x")]


def expected(rows):
    best = {}
    for page, _, html, _ in rows:
        if page is not None:
            best[html or ""] = max(page, best.get(html or "", page))
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        response = best.get(html or "")
        out.append((str(page), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if page == response else "revisit", None if page == response else response))
    return sorted(out, key=str)


def result(df):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in df.collect()), key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    assert result(warc.archived(pages)) == expected(ROWS)
    assert warc.archived(pages.limit(0)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html, "") for r in real.collect()]
    assert result(warc.archived(real)) == expected(rows)


def archive_files(spark, folder):
    system, path = open_folder(folder)
    out = {}
    for r in warc.manifest(spark, folder).collect():
        with system.open_input_stream(f"{path}/{r.name}", compression=None) as stream:
            out[r.name] = stream.read()
        assert (len(out[r.name]), hashlib.sha256(out[r.name]).hexdigest()) == (r.bytes, r.sha256)
    return out


def test_files_are_the_same_however_rows_are_dealt(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    small = warc.Archive(file_bytes=2_000)
    folders = [shared_folder(spark, "warc-test") for _ in range(2)]
    warc.write(real.repartition(7), folders[0], small)
    warc.write(real.orderBy(F.desc("page_id")).coalesce(1), folders[1], small)
    one, two = (archive_files(spark, f) for f in folders)
    assert one == two and len(one) >= 25
    pages = []
    for name in sorted(one):
        records = gzip.decompress(one[name]).split(b"WARC/1.1\r\n")[1:]
        assert b"WARC-Type: warcinfo" in records[0]
        pages += [int(line.split(b": ")[1]) for rec in records for line in rec.split(b"\r\n\r\n")[0].split(b"\r\n")
                  if line.startswith(b"X-Page-ID")]
    assert pages == sorted(pages)


def test_commit_can_run_again_and_lists_finished_files_only(spark):
    folder = shared_folder(spark, "warc-again")
    warc.write(spark.createDataFrame(ROWS, PAGES), folder)
    system, path = open_folder(folder)
    left = [f.path for f in system.get_file_info(__import__("pyarrow.fs").fs.FileSelector(path))]
    assert not any("_temporary" in f for f in left)
    again = warc.manifest(spark, folder).withColumn("temporary", F.lit("gone")).select(
        "shard", "name", "temporary", "records", "bytes", "sha256")
    other = shared_folder(spark, "warc-other")
    with pytest.raises(Exception, match="FileNotFound"):
        warc.commit(again, other)


def test_payload_is_read_back_and_damage_is_noticed(spark):
    folder = shared_folder(spark, "warc-payload")
    warc.write(spark.createDataFrame(ROWS, PAGES), folder)
    got = {r.page_id: r.payload for r in warc.read(spark, folder, with_payload=True).filter(
        "record_type = 'response'").collect()}
    assert bytes(got[7]) == "two\r\n\r\nparts é".encode() and bytes(got[5] or b"") == b""
    record = warc.page_record(1, "u", b"abc", None, False)
    assert warc.parse_record(record)[1].endswith(b"abc")
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abc\r\n", b"abd\r\n"))


def test_small_payloads_are_never_revisits(spark):
    folder = shared_folder(spark, "warc-least")
    warc.write(spark.createDataFrame(ROWS, PAGES), folder, warc.Archive(least_revisit=5))
    got = warc.read(spark, folder).filter("payload_bytes < 5")
    assert {r.record_type for r in got.collect()} == {"response"}


# -- sharding ---------------------------------------------------------------------------

def plain_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        used, held = 1, 0
        for s in sizes:
            if held + s > middle:
                used, held = used + 1, 0
            held += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("rows", [
    [(i, "w" * (1 + i * 37 % 900)) for i in range(500)],
    [(i, "hot text") for i in range(300)] + [(1000 + i, f"t{i}" * 5) for i in range(200)],
    [(1, "only"), (2, "only")],
    ODD + ODD,
])
def test_shards_are_a_least_contiguous_partition(spark, make, rows):
    got = minimax.sharded(make(rows, extra=True)).collect()
    assert len(got) == len(rows)
    digest = {(str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): brute.sha(t or "") for i, t in rows}
    place, sizes, total = {}, {}, {}
    for r in got:
        d = digest[str(r.doc_id), r["size"], r.text_crc32]
        assert place.setdefault(d, r.shard) == r.shard
        sizes[d] = sizes.get(d, 0) + r["size"]
        total[r.shard] = total.get(r.shard, 0) + r["size"]
    ordered = [place[d] for d in sorted(place)]
    assert ordered == sorted(ordered) and set(ordered) <= set(range(8))
    assert max(total.values()) == plain_capacity([sizes[d] for d in sorted(sizes)], 8)
    for shard in total:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_empty_table_has_no_shards(spark, make):
    assert minimax.sharded(make([])).count() == 0


def test_attach_keeps_every_row(spark):
    rows = spark.range(5_000).selectExpr("id", "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE id END AS k")
    groups = rows.filter("k IS NOT NULL").groupBy("k").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1")
    got = attach(rows, groups, "k", "n")
    assert got.count() == 5_000
    assert got.filter("top IS NOT NULL").count() == rows.filter("k = 1").count()


def shard_sizes(spark, ids, monkeypatch):
    """Sizes of the shards of pages with these ids, and whether shards follow the order."""
    monkeypatch.setattr(warc, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(warc, "LEAST_SHARDS", 8)
    slim = spark.createDataFrame([(i, hashlib.sha1(f"{n}".encode()).hexdigest(), 10) for n, i in enumerate(ids)],
                                 "page_id long, sha1 string, size long")
    count, assign = warc._shards(slim)
    found = assign(slim).select("page_id", "sha1", "shard").collect()
    assert len(found) == len(ids) and all(0 <= r.shard < count for r in found)
    ordered = sorted(found, key=lambda r: (r.page_id is not None, r.page_id or 0, r.sha1))
    shards = [r.shard for r in ordered]
    assert shards == sorted(shards)
    return count, Counter(shards)


def test_shards_part_null_ids_and_outliers(spark, monkeypatch):
    ids = {
        "a third null": [None] * 200 + list(range(400)),
        "one far id": [*range(1_000_000, 1_000_599), 2 ** 62],
        "both ends": [-2 ** 63, 2 ** 63 - 1, *range(598)],
        "one id": [7] * 300 + list(range(300)),
        "all null": [None] * 600,
        "steep": [2 ** i for i in range(62)] * 10,
    }
    for name, own in ids.items():
        count, sizes = shard_sizes(spark, own, monkeypatch)
        assert max(sizes.values()) <= 2 * len(own) / count + 1, name


def test_archives_with_null_and_extreme_ids(spark):
    rows = [(None, "u", f"text {i}", "x") for i in range(40)]
    rows += [(2 ** 62, "v", "text 1", "x"), (-2 ** 63, "w", "text 2", "x")]
    rows += [(i, None, f"text {i % 9}", "x") for i in range(60)]
    pages = spark.createDataFrame(rows, PAGES)
    assert result(warc.archived(pages)) == expected(rows)
