"""Quality rules: counts of a text and its repeated substrings by suffix array.

``measure`` gives one row per document, ``keep_good`` the documents that pass. Both read
whole texts, row by row, without a shuffle.

Suffixes of words are sorted by prefix doubling, document by document, many documents at
once. Adjacent suffixes with a common prefix of ``min_repeat`` words or more bound the
maximal repeated substrings; the union of their spans and the longest of them decide.

Defined cases: a null text is an empty one; empty and white texts have no words and fail;
other columns, nulls among them, pass through untouched; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parapet.llm.blocks import SPACED, Block, blocks, hashes, mix, shingles, word_bytes, words

LINES = word_bytes([0x0A])
SYMBOLS = ~word_bytes(b"#*$%&|<>")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "covered_words", "longest_repeat")


@dataclass(frozen=True)
class Rules:
    """Limits. ``repeat_words_pct`` is about windows of three words."""

    min_words: int = 50
    repeat_words_pct: int = 50
    min_repeat: int = 8
    covered_pct: int = 40
    longest: int = 400


def _apart(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Make equal values of different rows differ."""
    return mix(values + mix(row.astype(np.uint64) + np.uint64(1)))


def _repeated_cover(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words that the row holds at least twice."""
    keys, places = shingles(values, row, n)
    covered = np.zeros(len(values) + 1, np.int64)
    if len(keys):
        _, which, count = np.unique(_apart(keys, row[places]), return_inverse=True,
                                    return_counts=True)
        again = places[count[which] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + n, -1)
    return np.cumsum(covered[:-1]) > 0


def suffix_ranks(values: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Ranks of the windows of 1, 2, 4, ... words; the last list ranks whole suffixes.

    Two places share a rank if their windows are equal and in one row. A window over the
    row's end equals no other.
    """
    n = len(values)
    keys = _apart(values, row)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    active = order[np.repeat(sizes > 1, sizes)]
    levels, step = [rank], 1
    while len(active):
        ahead = active + step
        inside = ahead < n
        inside[inside] &= row[ahead[inside]] == row[active[inside]]
        second = np.full(len(active), -1, np.int64)
        second[inside] = rank[ahead[inside]]
        key = rank[active] * np.int64(n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        active, key, head = active[by], key[by], rank[active[by]]
        places = np.arange(len(active))
        new_group = np.concatenate([[True], head[1:] != head[:-1]])
        new_part = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(new_group, places, 0))
        part = np.maximum.accumulate(np.where(new_part, places, 0))
        rank = rank.copy()
        rank[active] = head + part - group
        sizes = np.diff(np.append(np.flatnonzero(new_part), len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
        levels.append(rank)
        step *= 2
    return levels


def repeats(values: np.ndarray, row: np.ndarray, shortest: int) -> np.ndarray:
    """Length of the longest repeated substring that begins at each word, 0 below ``shortest``."""
    longest = np.zeros(len(values) + 1, np.int64)
    if len(values) < 2:
        return longest[:-1]
    levels = suffix_ranks(values, row)
    n = len(values)
    suffixes = np.empty(n, np.int64)
    suffixes[levels[-1]] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    known = min(len(levels) - 1, int(np.log2(shortest)))
    close = levels[known][left] == levels[known][right]
    left, right = left[close], right[close]
    common = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        # a rank is shared within one row only, so equal ranks never leave the row
        common[same] += 1 << k
    common[common < shortest] = 0
    np.maximum.at(longest, left, common)
    np.maximum.at(longest, right, common)
    return longest[:-1]


def _sums(row: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=weights, minlength=rows).astype(np.int64)


def measure_block(block: Block, shortest: int) -> dict[str, np.ndarray]:
    count, data = len(block), block.data
    found = words(block, SPACED)
    values = hashes(data, found.start, found.end)
    letters = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & SPACED[data])])
    marks = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    lines = words(block, LINES)
    holds = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
    line_row = lines.row[holds]
    line_keys = _apart(hashes(data, lines.start[holds], lines.end[holds]), line_row)
    _, first = np.unique(line_keys, return_index=True)
    again = np.ones(len(line_keys), np.int64)
    again[first] = 0
    longest = repeats(values, found.row, shortest)
    spans = np.zeros(len(values) + 1, np.int64)
    begins = np.flatnonzero(longest)
    np.add.at(spans, begins, 1)
    np.add.at(spans, begins + longest[begins], -1)
    most = np.zeros(count, np.int64)
    np.maximum.at(most, found.row, longest)
    return {
        "n_words": found.per_row.astype(np.int64),
        "word_chars": letters[block.offsets[1:]] - letters[block.offsets[:-1]],
        "n_symbols": marks[block.offsets[1:]] - marks[block.offsets[:-1]],
        "n_dup_lines": _sums(line_row, again, count),
        "n_repeat_words": _sums(found.row, _repeated_cover(values, found.row, 3), count),
        "covered_words": _sums(found.row, np.cumsum(spans[:-1]) > 0, count),
        "longest_repeat": most,
    }


def verdicts(found: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Whether the counts fail, and whether the document is kept."""
    failed = (found["n_words"] < rules.min_words) | (
        100 * found["n_repeat_words"] > rules.repeat_words_pct * found["n_words"])
    repeated = (100 * found["covered_words"] > rules.covered_pct * found["n_words"]) | (
        found["longest_repeat"] > rules.longest)
    return failed, ~failed & ~repeated


def measure(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Counts, repeats and verdict of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            found = measure_block(block, rules.min_repeat)
            failed, kept = verdicts(found, rules)
            names = [key, *MEASURES, "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), *(pa.array(found[m]) for m in MEASURES),
                 pa.array(failed), pa.array(kept)], names)

    columns = ", ".join(f"{m} long" for m in MEASURES)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"{key} {kind}, {columns}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents that pass, all columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            kept = verdicts(measure_block(block, rules.min_repeat), rules)[1]
            yield block.rows.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
