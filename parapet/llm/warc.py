"""WARC archives: a deterministic sharded writer and a checking reader.

Writing: the order of page ids and digests is cut into shards of about equal payload bytes
by histograms that are refined where they are full, so the same table gives the same shards
whatever the partitions. Rows are dealt and sorted by
shard and page id; a task streams them into one gzip member per record and rolls to a new
file when the compressed size would pass the limit. Headers, lengths and digests are made
anew from the payload. Of equal payloads the largest page id is the response, the others
are revisits that name it.

Committing: a task writes under a temporary name and returns a manifest row per file. The
manifest is written by Spark, so it lists the files of successful attempts only; a second
job renames exactly those, and the final manifest is written last. A job that dies before
leaves no final manifest; a renaming task that runs twice finds its work done.

Defined cases: a null html is an empty payload; rows without a page id are records too (a
response only if no row of the group has an id); all rows with the group's largest id are
responses; a null url has no header; control characters of a url are percent-encoded;
an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parapet.llm.shared import attach, open_folder, stage
from parapet.session import shared_folder

DATE = "2000-01-01T00:00:00Z"
SHARD_BYTES = 256 << 20
LEAST_SHARDS, MOST_SHARDS = 64, 1 << 16
BINS_PER_SHARD = 4
HASH_DIGITS = 15
CUTS = "_cell long, _by_id boolean, _low decimal(20,0), _width decimal(20,0)"
ENDS = "_cell long, _bin long, _next long, _shard int"
RECORD_SPACE = uuid.UUID("6f1c2f6e-6a52-5d0e-9d3b-0d1f6d0f5a11")
MANIFEST = "shard int, name string, temporary string, records long, bytes long, sha256 string"


@dataclass(frozen=True)
class Archive:
    """Roll size of a file after compression, and the least payload that can be a revisit."""

    file_bytes: int = 128 << 20
    least_revisit: int = 0
    level: int = 6


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{page}/{digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, response: int | None,
                revisit: bool) -> bytes:
    """A response record, or a revisit record that keeps the HTTP header only."""
    digest = digest_of(payload)
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"),
               ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE)]
    if url is not None:
        quoted = re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)
        headers.append(("WARC-Target-URI", quoted))
    if page is not None:
        headers.append(("X-Page-ID", str(page)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(response, digest)),
                    ("X-Refers-To-Page-ID", str(response))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
                ("Content-Type", "application/http; msgtype=response")]
    return _record(headers, block)


def info_record(name: str) -> bytes:
    body = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)),
                    ("WARC-Date", DATE), ("WARC-Filename", name),
                    ("WARC-Block-Digest", f"sha1:{digest_of(body)}"),
                    ("Content-Type", "application/warc-fields")], body)


def _hash(sha1: Column) -> Column:
    return F.conv(F.substring(sha1, 1, HASH_DIGITS), 16, 10).cast("decimal(20,0)")


@dataclass
class _Level:
    """One refinement: how open cells are cut, and what becomes of each bin."""

    cuts: list[tuple]  # cell, by id, low, width
    ends: list[tuple]  # cell, bin, next cell or shard


def _binned(rows: DataFrame, level: _Level) -> DataFrame:
    """Add ``_bin`` within ``_cell``: of the page id, or of the digest where ids are equal.
    A null id is the bin before all others."""
    if len(level.cuts) == 1:
        cell, by_id, *numbers = level.cuts[0]
        low, width = (F.lit(n).cast("decimal(20,0)") for n in numbers)
        rows = rows.withColumns({"_by_id": F.col("_cell") == F.lit(cell) if by_id else F.lit(False),
                                 "_low": low, "_width": width})
    else:
        cuts = rows.sparkSession.createDataFrame(level.cuts, CUTS)  # at most 2 * MOST_SHARDS rows
        rows = rows.join(F.broadcast(cuts), "_cell", "left")
    value = F.when(F.col("_by_id"), F.col("page_id").cast("decimal(20,0)")).otherwise(_hash(F.col("sha1")))
    far = (value - F.col("_low")).cast("decimal(22,0)")
    return rows.withColumn("_far", far).withColumn("_bin", F.when(
        F.col("_cell").isNotNull(), F.coalesce(F.expr("_far div _width"), F.lit(-1))).cast("long")).drop(
        "_by_id", "_low", "_width", "_far")


def _moved(rows: DataFrame, level: _Level) -> DataFrame:
    """Rows of the level's cells go to their next cell or get their shard."""
    ends = rows.sparkSession.createDataFrame(level.ends, ENDS)  # at most 10 * MOST_SHARDS rows
    joined = _binned(rows, level).join(F.broadcast(ends), ["_cell", "_bin"], "left")
    return joined.withColumn("shard", F.coalesce("shard", "_shard")).withColumn("_cell", F.col("_next")).drop(
        "_bin", "_next", "_shard")


def _shards(slim: DataFrame) -> tuple[int, Callable[[DataFrame], DataFrame]]:
    """Number of shards, and a function that adds the shard of each (page id, digest).

    Quantiles by refinement: the range of a cell is cut into bins of equal width, in number
    as its bytes ask for; a bin that holds more than a shard is a cell of the next level,
    cut between its own least and largest id, so far outliers cost one level. Where all ids
    of a cell are equal or null the digest is cut the same way. The shards are contiguous in
    the order of ids and digests and hold at most twice the mean, except for rows that
    repeat both. The driver gets one row per bin, at most ``2 * BINS_PER_SHARD`` a shard.
    """
    weight = F.sum(F.col("size") + 512)
    found = slim.agg(weight, F.min("page_id"), F.max("page_id")).first()
    total, low, high = found
    if total is None:
        return 1, lambda rows: rows.withColumn("shard", F.lit(0))
    count = min(max(LEAST_SHARDS, math.ceil(total / SHARD_BYTES)), MOST_SHARDS)
    target = total / count
    top = 16 ** HASH_DIGITS - 1
    # open cells: number -> (path, by id, low, high, bytes)
    cells = {0: ((), True, low, high, total) if low is not None else ((), False, 0, top, total)}
    levels, leaves, number = [], [], 0
    rows = slim.select("page_id", "sha1", "size", F.lit(0).cast("long").alias("_cell"),
                       F.lit(None).cast("int").alias("shard"))
    while cells:
        cuts = [(c, by_id, Decimal(lo), Decimal(max(1, -(-(hi - lo + 1) // (BINS_PER_SHARD * math.ceil(s / target))))))
                for c, (_, by_id, lo, hi, s) in cells.items()]
        level = _Level(cuts, [])
        sums = _binned(rows.filter("_cell IS NOT NULL"), level).groupBy("_cell", "_bin").agg(
            weight, F.min("page_id"), F.max("page_id"), F.min(_hash(F.col("sha1"))), F.max(_hash(F.col("sha1")))).collect()
        opened = {}
        for cell, place, held, least, most, first, last in sorted(sums, key=lambda r: r[:2]):
            path = (*cells[cell][0], place)
            by_id = least is not None and least != most
            if held > target and (by_id or first != last):
                number += 1
                span = (least, most) if by_id else (int(first), int(last))
                opened[number] = (path, by_id, *span, held)
                level.ends.append((cell, place, number, None))
            else:
                leaves.append((path, held, level, cell, place))
        levels.append(level)
        rows, cells = _moved(rows, level) if opened else rows, opened
    filled = 0
    for _, held, level, cell, place in sorted(leaves, key=lambda leaf: leaf[0]):
        level.ends.append((cell, place, None, min(int(filled / target), count - 1)))
        filled += held

    def assign(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_cell", F.lit(0).cast("long")).withColumn("shard", F.lit(None).cast("int"))
        for level in levels:
            rows = _moved(rows, level)
        return rows.drop("_cell")

    return count, assign


class _Files:
    """Rolling files of one shard, under temporary names."""

    def __init__(self, system: pafs.FileSystem, folder: str, archive: Archive):
        self.system, self.folder, self.archive = system, folder, archive
        self.attempt, self.done = uuid.uuid4().hex[:12], []
        self.out, self.shard, self.number = None, None, 0

    def add(self, shard: int, record: bytes) -> None:
        member = gzip.compress(record, self.archive.level, mtime=0)
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.records and self.size + len(member) > self.archive.file_bytes:
            self.close()
        if self.out is None:
            self.name = f"shard-{shard:05d}-{self.number:05d}.warc.gz"
            self.number += 1
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.out = self.system.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
            self.size, self.records, self.hash = 0, 0, hashlib.sha256()
            self._write(gzip.compress(info_record(self.name), self.archive.level, mtime=0))
        self._write(member)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.name, self.temporary, self.records, self.size, self.hash.hexdigest()))
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        columns = [pa.array([d[i] for d in self.done], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names)


def write(pages: DataFrame, folder: str, archive: Archive = Archive()) -> DataFrame:
    """Write ``page_id, url, html`` as archives below ``folder``; returns the manifest."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = stage(pages.select("page_id", F.sha1(html).alias("sha1"),
                              F.octet_length(html).cast("long").alias("size")), "warc-slim")
    keyed = slim.filter(F.col("size") >= archive.least_revisit).select(
        "page_id", "sha1", F.concat_ws("/", "sha1", "size").alias("key"))
    groups = stage(keyed.groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("members"))
                   .filter("members > 1"), "warc-groups")
    revisits = attach(keyed, groups, "key", "members").filter(
        "response IS NOT NULL AND NOT page_id <=> response").select("page_id", "sha1", "response").distinct()
    count, assign = _shards(slim)
    rows = pages.select("page_id", F.sha1(html).alias("sha1"), F.lit(1).alias("turn"), "url",
                        html.alias("payload"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("response"))
    notes = revisits.select("page_id", "sha1", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("url"),
                            F.lit(None).cast("binary").alias("payload"), "response")
    dealt = (assign(rows.unionByName(notes)).repartition(count, "shard")
             .sortWithinPartitions("shard", "page_id", "sha1", "turn", "url"))
    system, path = open_folder(folder)
    system.create_dir(f"{path}/_temporary", recursive=True)

    def run(batches):
        system, path = open_folder(folder)
        files, note = _Files(system, path, archive), None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (
                "shard", "page_id", "sha1", "turn", "url", "payload", "response")]
            for i in range(batch.num_rows):
                shard, page, sha1, turn, url, payload, response = (c[i].as_py() for c in columns)
                if turn == 0:
                    note = (page, sha1, response)
                    continue
                revisit = note is not None and note[:2] == (page, sha1)
                files.add(shard, page_record(page, url, payload, note[2] if revisit else None, revisit))
        files.close()
        yield files.manifest()

    written = stage(dealt.mapInArrow(run, MANIFEST), "warc-manifest")
    return commit(written, folder)


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Rename the files of a manifest to their final names, then publish the manifest."""
    def run(batches):
        system, path = open_folder(folder)
        for batch in batches:
            for name, temporary in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                source, target = f"{path}/{temporary}", f"{path}/{name}"
                if system.get_file_info(source).type != pafs.FileType.NotFound:
                    system.move(source, target)
                elif system.get_file_info(target).type == pafs.FileType.NotFound:
                    raise FileNotFoundError(target)
            yield batch

    written.mapInArrow(run, MANIFEST).drop("temporary").write.parquet(f"{folder}/_manifest")
    system, path = open_folder(folder)
    system.delete_dir(f"{path}/_temporary")  # what failed attempts left
    return manifest(written.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST.replace("temporary string, ", "")).parquet(f"{folder}/_manifest")


def _inflate(stream):
    """Bytes of each gzip member of a stream, one member at a time."""
    pending = b""
    while True:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            data = pending or stream.read(1 << 20)
            if not data:
                if parts:
                    raise EOFError("a gzip member ends early")
                return
            parts.append(unzip.decompress(data))
            pending = unzip.unused_data
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises if length or block digest are wrong."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:-4]
    if lines[0] != "WARC/1.1" or len(block) != int(headers["Content-Length"]):
        raise ValueError("not a record of the stated length")
    if headers["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
        raise ValueError("the block does not have the stated digest")
    return headers, block


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per page record of the manifest's files; digests are checked on the way."""
    def run(batches):
        system, path = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in _inflate(stream):
                        row = _page_row(member, with_payload)
                        if row:
                            out.append((name, *row))
                        if len(out) >= (64 if with_payload else 4096):
                            yield _rows(out, with_payload)
                            out = []
                yield _rows(out, with_payload)

    files = manifest(spark, folder).select("name")
    dealt = files.repartition(max(1, files.count()), "name")
    schema = ("file string, page_id long, url string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long")
    return dealt.mapInArrow(run, schema + ", payload binary" * with_payload)


def _page_row(member: bytes, with_payload: bool):
    headers, block = parse_record(member)
    if headers["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError("the payload does not have the stated digest")
    number = lambda k: int(headers[k]) if k in headers else None
    row = (number("X-Page-ID"), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"],
           number("X-Refers-To-Page-ID"))
    return (*row, payload if headers["WARC-Type"] == "response" else None) if with_payload else row


def _rows(out: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["file", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    n = 8 if with_payload else 7
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(n)], names[:n])


def archived(pages: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """Write the pages to a new shared folder and read the archives back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write(pages, folder, archive)
    return read(pages.sparkSession, folder)
