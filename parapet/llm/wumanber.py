"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of ten consecutive words of every benchmark item (an item of
fewer words is one window). For each pattern length there is a shift table over blocks of
two words: a search position moves on by the shift, positions of shift 0 look into the
bucket of their last block and first word, and the bytes of the whole window
confirm the occurrence. The search runs over many stretches of text at once. A shift table
has eight slots or more for each pattern, up to 2^``MOST_BITS``.

Items are dealt by hash to blocks of about ``BLOCK_TEXT`` bytes of text. Spark tasks compile
each block into one file of the shared folder, and workers map the files into memory; the
driver sees their names only. Every text is searched for all blocks in one pass.

Defined cases: a null or empty text has no words, an item without words no window; items
that share an id are one item, a null id is written ``null``; repeated rows are searched
alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parapet.llm.blocks import ALNUM, LOWER, Block, blocks, hashes, mix, words
from parapet.llm.shared import arrive, open_folder, save
from parapet.session import shared_folder

WINDOW = 10
LEAST_BITS, MOST_BITS = 18, 25
BLOCK_TEXT = 8 << 20
STRETCH = 128


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x2545F4914F6CDD1D) + second)


def _slot(pairs: np.ndarray, size: int) -> np.ndarray:
    """Place of a block hash in a shift table of ``size`` slots, a power of two."""
    return (pairs >> np.uint64(65 - size.bit_length())).astype(np.int64)


def table_size(patterns: int) -> int:
    return 1 << min(max(LEAST_BITS, patterns.bit_length() + 3), MOST_BITS)


def _block_of(values: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Hash of the search block whose last word is at ``end``."""
    return _pair(values[end - 1], values[end]) if width == 2 else mix(values[end])


def item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    block = Block(None, data, np.array([0, len(data)]))
    found = words(block, ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(found.start, found.end)]


def compile_patterns(items: list[tuple[object, str | None]], window: int = WINDOW):
    """Tables of one block of items: arrays, and facts with ids and pattern lengths."""
    by_length: dict[int, dict[bytes, list[int]]] = {}
    ids: dict[str, int] = {}
    for item, text in items:
        own = item_words(text)
        if not own:
            continue
        number = ids.setdefault("null" if item is None else str(item), len(ids))
        length = min(window, len(own))
        for i in range(len(own) - length + 1):
            holders = by_length.setdefault(length, {}).setdefault(b" ".join(own[i:i + length]), [])
            if number not in holders:
                holders.append(number)
    arrays: dict[str, np.ndarray] = {}
    for length, patterns in by_length.items():
        width = min(2, length)
        whole = list(patterns)
        data = np.frombuffer(b" ".join(whole), np.uint8)
        found = words(Block(None, data, np.array([0, len(data)])), ALNUM)
        values = hashes(data, found.start, found.end).reshape(-1, length)
        columns = np.ascontiguousarray(values.T)
        size = table_size(len(whole))
        shift = np.full(size, length - width + 1, np.uint8)
        for end in range(width - 1, length):
            np.minimum.at(shift, _slot(_block_of(columns, np.array(end), width), size), np.uint8(length - 1 - end))
        bucket = _pair(_block_of(columns, np.array(length - 1), width), columns[0])
        order = np.argsort(bucket, kind="stable")
        holders = list(patterns.values())
        arrays |= {
            f"shift{length}": shift, f"bucket{length}": bucket[order],
            f"bytes{length}": np.frombuffer(b"".join(whole[i] for i in order), np.uint8),
            f"ends{length}": np.cumsum([len(whole[i]) for i in order]),
            f"items{length}": np.array([n for i in order for n in holders[i]], np.int64),
            f"item_ends{length}": np.cumsum([len(holders[i]) for i in order]),
        }
    return arrays, {"ids": list(ids), "lengths": sorted(by_length)}


def _positions(values: np.ndarray, shift: np.ndarray, length: int, width: int) -> np.ndarray:
    """Ends of windows that the shift table does not rule out."""
    at = np.arange(0, len(values), STRETCH)
    stop = np.minimum(at + STRETCH, len(values))
    at = np.maximum(at, length - 1)
    found = []
    live = at < stop
    at, stop = at[live], stop[live]
    while len(at):
        step = shift[_slot(_block_of(values, at, width), len(shift))]
        found.append(at[step == 0])
        at = at + np.maximum(step, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def occurrences(block: Block, table: dict[str, np.ndarray], lengths: list[int]):
    """Confirmed occurrences in a block: first word, window length, pattern's table place."""
    data = LOWER[block.data]
    found = words(block, ALNUM, data)
    values = hashes(data, found.start, found.end)
    hits = []
    for length in lengths:
        if len(values) < length:
            continue
        width = min(2, length)
        ends = _positions(values, table[f"shift{length}"], length, width)
        begins = ends - length + 1
        one_row = found.row[begins] == found.row[ends]
        ends, begins = ends[one_row], begins[one_row]
        bucket = table[f"bucket{length}"]
        wanted = _pair(_block_of(values, ends, width), values[begins])
        low = np.searchsorted(bucket, wanted, side="left")
        many = np.searchsorted(bucket, wanted, side="right") - low
        place = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        begins = np.repeat(begins, many)
        text, stops = table[f"bytes{length}"], table[f"ends{length}"]
        for first, p in zip(begins.tolist(), place.tolist()):
            pattern = text[(stops[p - 1] if p else 0):stops[p]].tobytes()
            own = b" ".join(data[a:b].tobytes() for a, b in zip(
                found.start[first:first + length], found.end[first:first + length]))
            if own == pattern:
                hits.append((first, length, p))
    return found, hits


def item_blocks(benchmark: DataFrame, size: int = BLOCK_TEXT) -> tuple[DataFrame, int]:
    """The distinct items dealt to blocks by hash, and the number of blocks. An item that
    repeats, or whose id does with other texts, may lie in several blocks: ids are joined
    again for each document."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    held = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    number = max(1, -(-held // size))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(number))), number


def ship_patterns(benchmark: DataFrame, window: int = WINDOW) -> list[str]:
    """Names of the shipped files, one for each block of items."""
    spark = benchmark.sparkSession
    folder = shared_folder(spark, "patterns")
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    items, number = item_blocks(benchmark)

    def run(batches):
        names, held, block = [], [], None
        for batch in batches:
            for own, item, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if own != block and held:
                    names.append(save(folder, "patterns", *compile_patterns(held, window)))
                    held = []
                block = own
                held.append((item, text))
        if held:
            names.append(save(folder, "patterns", *compile_patterns(held, window)))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    dealt = items.select("block", "item_id", "text").repartition(number, "block").sortWithinPartitions("block")
    names = sorted(r[0] for r in dealt.mapInArrow(run, "name string").collect())
    for name in names:
        spark.sparkContext.addFile(f"{folder}/{name}")
    return names


def _search(block: Block, names: list[str]):
    """Words per row, hit words per row, and the ids of occurring items per row."""
    items: list[set[str]] = [set() for _ in range(len(block))]
    found, cover = None, None
    for name in names:
        table, facts = arrive(name)
        found, hits = occurrences(block, table, facts["lengths"])
        if cover is None:
            cover = np.zeros(len(found.row) + 1, np.int64)
        for first, length, p in hits:
            cover[first] += 1
            cover[first + length] -= 1
            ends = table[f"item_ends{length}"]
            items[found.row[first]].update(
                facts["ids"][n] for n in table[f"items{length}"][(ends[p - 1] if p else 0):ends[p]])
    if found is None:
        found = words(block, ALNUM, LOWER[block.data])
        cover = np.zeros(len(found.row) + 1, np.int64)
    hit = np.bincount(found.row, weights=np.cumsum(cover[:-1]) > 0, minlength=len(block))
    return found.per_row, hit.astype(np.int64), items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (occurring item ids, sorted) for every document."""
    names = ship_patterns(benchmark, window)

    def run(batches):
        for block in blocks(batches):
            count, hit, items = _search(block, names)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), pa.array(count, pa.int64()), pa.array(hit),
                 pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_hit long, items array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs, all columns as they are."""
    names = ship_patterns(benchmark, window)

    def run(batches):
        for block in blocks(batches):
            yield block.rows.filter(pa.array(_search(block, names)[1] == 0))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The searched documents with the count and digest of their items."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
