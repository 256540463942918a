"""Texts as byte blocks: numpy views of Arrow batches, words and their hashes.

A block holds whole rows whose texts are about ``BLOCK_BYTES`` together, or one longer
text. Words are maximal runs of word bytes; every separator of the operators is an ASCII
byte, so runs of bytes and runs of code points are the same words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 2048
BASE = 0x9E6C63D0A5A2D5B3
_POWERS: dict[str, np.ndarray] = {}


def word_bytes(separators: Iterable[int]) -> np.ndarray:
    """Table of 256 booleans: true for bytes that are no separator."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


SPACED = word_bytes([0x20, *range(0x09, 0x0E)])
ALNUM = word_bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Block:
    """Rows, the bytes of their texts on end, and where each text begins."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()


@dataclass
class Words:
    """Byte ranges of words in a block, and the row of each."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    per_row: np.ndarray


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text",
           size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks. A null text is an empty one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        texts = texts.cast(pa.large_string())
        _, offset_buffer, data_buffer = texts.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
            last = min(max(last, first + 1), first + BLOCK_ROWS, len(texts))
            low, high = offsets[first], offsets[last]
            yield Block(batch.slice(first, last - first), data[low:high], offsets[first:last + 1] - low)
            first = last


def words(block: Block, table: np.ndarray, data: np.ndarray | None = None) -> Words:
    """The words of every row; no word spans two rows."""
    data = block.data if data is None else data
    inside = table[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    begins = block.offsets[:-1]
    begins = begins[begins < len(data)]
    before[begins] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    closes = block.offsets[1:] - 1
    after[closes[closes >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = block.row_of(start)
    return Words(start, end, row, np.bincount(row, minlength=len(block)))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, the same wherever the range stands."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the place of each first word."""
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(values) - n + 1
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + values[i:i + count])
    places = np.flatnonzero(row[:count] == row[n - 1:])
    return out[places], places


def weighted_rows(place: np.ndarray, row: np.ndarray, rows: int, table: np.ndarray) -> np.ndarray:
    """For each row the sum of ``table[place]`` over its entries; equal entries of a row are
    counted first."""
    out = np.zeros((rows, table.shape[1]), np.float32)
    kinds = max(len(table), 1)
    key = row * kinds + place
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    times = np.diff(np.append(first, len(key))).astype(np.float32)
    own_row, own_place = key[first] // kinds, key[first] % kinds
    cuts = np.searchsorted(own_row, np.arange(rows + 1))
    for i in range(rows):
        a, b = cuts[i], cuts[i + 1]
        if a < b:
            out[i] = times[a:b] @ table[own_place[a:b]]
    return out
