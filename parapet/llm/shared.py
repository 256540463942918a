"""Written intermediates, files for the workers, and joins that stand busy keys."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.session import shared_folder

HOT_KEYS = 1000
ARROW_ROWS = "1000"


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: long texts must fit into a worker many at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage ends here, and a lost
    executor costs only the tasks that read it."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def open_folder(uri: str):
    """File system and path of a shared folder, for drivers and workers alike."""
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def save(folder: str, purpose: str, arrays: dict[str, np.ndarray], facts: dict) -> str:
    """Write arrays as one file that ``arrive`` maps into memory; runs anywhere. Returns its
    name, new for each call, so that a repeated task disturbs nobody."""
    name = f"{purpose}-{uuid.uuid4().hex[:12]}.bin"
    layout, at = {}, 0
    for key, value in arrays.items():
        layout[key] = (str(value.dtype), list(value.shape), at)
        at += -(-value.nbytes // 64) * 64
    head = json.dumps({"arrays": layout, "facts": facts}).encode()
    system, path = open_folder(folder)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(len(head).to_bytes(8, "little") + head)
        out.write(b"\0" * (-(8 + len(head)) % 64))
        for value in arrays.values():
            out.write(np.ascontiguousarray(value).tobytes())
            out.write(b"\0" * (-value.nbytes % 64))
    return name


def ship(spark: SparkSession, purpose: str, arrays: dict[str, np.ndarray], **facts) -> str:
    """Send arrays to all executors as one file that workers map into memory.

    The caller proves the size bound. Returns the name for ``arrive``.
    """
    folder = shared_folder(spark, purpose)
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    name = save(folder, purpose, arrays, facts)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def arrive(name: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays and facts of a shipped file, mapped, not read."""
    path = SparkFiles.get(name)
    with io.open(path, "rb") as file:
        size = int.from_bytes(file.read(8), "little")
        head = json.loads(file.read(size))
    base = -(-(8 + size) // 64) * 64
    out = {}
    for key, (dtype, shape, at) in head["arrays"].items():
        count = int(np.prod(shape))
        out[key] = (np.memmap(path, dtype=dtype, mode="r", offset=base + at,
                              shape=tuple(shape)).view(np.ndarray)
                    if count else np.zeros(tuple(shape), dtype))
    return out, head["facts"]


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of rows with groups (one row per key, ``size``: its number of rows).

    The thousand largest groups are joined by broadcast: at most ``HOT_KEYS`` short rows,
    whatever the input. Every other group then holds at most a thousandth of the rows, so
    the shuffled join of the rest has no busy key; rows without a key stay where they are. ``groups`` should be a written table.
    """
    added = [c for c in groups.columns if c not in (key, size)]
    busy = groups.orderBy(F.desc(size), F.col(key)).limit(HOT_KEYS)
    busy = busy.select(F.col(key), F.lit(True).alias("_busy"),
                       *[F.col(c).alias(f"_busy_{c}") for c in added])
    lone = rows.filter(F.col(key).isNull()).select(
        *rows.columns, *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in added])
    marked = rows.filter(F.col(key).isNotNull()).join(F.broadcast(busy), key, "left")
    found = marked.filter("_busy").select(
        *rows.columns, *[F.col(f"_busy_{c}").alias(c) for c in added])
    rest = marked.filter("_busy IS NULL").select(*rows.columns)
    return found.unionByName(rest.join(groups.select(key, *added), key, "left")).unionByName(lone)


STEPS_PER_DOUBLING = 16


def most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most ``most`` of them.

    Rows are cut at a step of the count's logarithm, so rows of equal count stay together.
    Only the number of rows per step is collected (about a thousand steps), and nothing is
    sorted: the cut is a filter, in every task.
    """
    step = F.floor(F.log2(F.col(count)) * STEPS_PER_DOUBLING)
    held, least = 0, None
    for at, rows in sorted(((r[0], r[1]) for r in table.groupBy(step.alias("step")).count().collect()), reverse=True):
        if held + rows > most:
            break
        held, least = held + rows, at
    return table.filter(step >= least) if least is not None else table.limit(0)
