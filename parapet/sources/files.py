"""Reading folders of files.

Tasks list the folders and read the files; the listing is a table in the shared folder. The
driver learns how many files there are and how large, not their names, so it holds as much
for ten million files as for ten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parapet.operators.intake import MAX_FILE_BYTES, TOO_LARGE, file_rows
from parapet.session import shared_folder

LISTED = "uri string, root string, below string, modificationTime timestamp, length long, folder boolean"
LISTED_ROWS = 10_000  # entries of a listing in one batch
READ_BYTES = 16 << 20  # content in one batch; a larger file is a batch of its own
TASK_BYTES = 256 << 20  # content that one task reads, one batch after the other


def _roots(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """The folders that a name or pattern stands for, as encoded and as plain names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    paths = [status.getPath() for status in found or ()]
    if not paths:
        raise FileNotFoundError(f"no such folder: {folder}")
    return [(path.toUri().toString(), path.toString()) for path in paths]


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of folders, each named from its root on; of a file, the file itself."""
    shape = pa.schema([("uri", pa.string()), ("root", pa.string()), ("below", pa.string()),
                       ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("folder", pa.bool_())])
    for batch in batches:
        for row in batch.to_pylist():
            system, root = pafs.FileSystem.from_uri(row["uri"])
            root = root.rstrip("/")
            place = f"{root}/{row['below']}" if row["below"] else root or "/"
            itself = system.get_file_info(place)
            single = itself.type == pafs.FileType.File
            entries = [itself] if single else [
                e for e in system.get_file_info(pafs.FileSelector(place)) if not _hidden(e.base_name)]
            for start in range(0, len(entries), LISTED_ROWS):
                some = entries[start:start + LISTED_ROWS]
                yield pa.RecordBatch.from_pylist([{
                    "uri": row["uri"], "root": row["root"],
                    "below": "" if single else f"{row['below']}/{e.base_name}".lstrip("/"),
                    "modificationTime": None if e.mtime_ns is None else e.mtime_ns // 1000,
                    "length": e.size, "folder": e.type == pafs.FileType.Directory} for e in some], schema=shape)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``uri, root, below, path, modificationTime, length`` of the files below a folder whose
    names fit the pattern, without hidden and empty ones, as Spark's readers do. Level by
    level: the folders found in one are listed in the next."""
    kept, levels = shared_folder(spark, "listing"), []
    waiting = spark.createDataFrame(_roots(spark, folder), "uri string, root string").withColumn("below", F.lit(""))
    while True:
        levels.append(f"{kept}/level-{len(levels)}")
        waiting.mapInArrow(_list, LISTED).write.parquet(levels[-1])
        folders = spark.read.schema(LISTED).parquet(levels[-1]).where("folder")
        if folders.isEmpty():
            break
        waiting = folders.select("uri", "root", "below").repartition(spark.sparkContext.defaultParallelism)
    files = spark.read.schema(LISTED).parquet(*levels).where(~F.col("folder") & (F.col("length") > 0))
    path = F.when(F.col("below") == "", F.col("root")).otherwise(
        F.concat(F.regexp_replace("root", "/$", ""), F.lit("/"), "below"))
    named = files.select("uri", "root", "below", path.alias("path"), "modificationTime", "length")
    fitting = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    return named.where(F.regexp_extract("path", r"(?s)[^/]*\z", 0).rlike(rf"(?s)\A(?:{fitting})\z"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed files with their content, in batches of bounded size."""
    def read(row: dict) -> bytes:
        system, root = pafs.FileSystem.from_uri(row["uri"])
        root = root.rstrip("/")
        with system.open_input_stream(f"{root}/{row['below']}" if row["below"] else root) as file:
            return file.read()

    for batch in batches:
        rows, start, size = batch.select(["uri", "below"]).to_pylist(), 0, 0
        plain, contents = batch.select(["path", "modificationTime", "length"]), []
        for at, row in enumerate(rows, 1):
            contents.append(read(row))
            size += len(contents[-1])
            if size >= READ_BYTES or at == len(rows):
                piece = plain.slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(contents, pa.binary())], [*piece.schema.names, "content"])
                start, size, contents = at, 0, []


def with_content(listed: DataFrame) -> DataFrame:
    """``path, modificationTime, length, content`` of listed files."""
    total = listed.agg(F.sum("length")).first()[0] or 0
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return listed.repartition(tasks).mapInArrow(
        _read, "path string, modificationTime timestamp, length long, content binary")


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """Files below a folder whose names fit the pattern, which minds upper and lower case."""
    return with_content(list_files(spark, folder, pattern))


def relative_path(path, folder: str):
    """The path below the scanned folder."""
    root = folder.rstrip("/").removeprefix("file:")
    return F.regexp_replace(path, rf"^(?:[a-z0-9]+:/*(?=/))?\Q{root}\E/", "")


def _rows(files: DataFrame, name: Column) -> DataFrame:
    return file_rows(files, name, F.col("content"), F.lit(None).cast("string"))


def uploads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Scanned files as upload rows, named by their relative path."""
    return _rows(scan_files(spark, folder, pattern), relative_path(F.col("path"), folder))


def small_uploads(
    spark: SparkSession, folder: str, limit: int = MAX_FILE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Uploads within the size limit, and dead letters of the larger files.

    The listing tells the sizes, so the content of a larger file is never read.
    """
    listed = list_files(spark, folder)
    name = relative_path(F.col("path"), folder)
    large = listed.where(F.col("length") > limit).select(
        name.alias("filename"), "length", F.lit(None).cast("string").alias("mime"),
        F.lit(TOO_LARGE).alias("reason"),
    )
    return _rows(with_content(listed.where(F.col("length") <= limit)), name), large
