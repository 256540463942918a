"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point. Three letters in
a row are bound: the first vector permuted twice, the second once, the third as it is,
multiplied. A text is the bundle (sum) of its letter triples, a language the bundle of the
texts that are labelled with it. The language with the largest cosine wins.

Letters are lower-cased; any other character is a blank, as are the ends of a text, and
triples of blanks are left out. Only vectors of ``DIMENSIONS`` numbers per language leave the tasks; the number of
languages is the number of labels and is taken to be small. A text of any length is bundled
in slices of ``SLICE`` characters and ``KINDS`` distinct triples.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every
text if nothing was learned; the first language in alphabetical order wins a tie; a null
label is not learned from; repeated rows are treated alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parapet.llm.blocks import Block, blocks, mix, weighted_rows
from parapet.llm.shared import arrive, ship

DIMENSIONS = 512
FOLDS, FOLD = 3, 1
UNKNOWN = "und"
SMALL_ALPHABET = 96
SLICE, KINDS = 1 << 20, 1 << 14


def with_fold(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.withColumn("held_out", fold == FOLD)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point; the blank (0) has one too."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    seeds = mix(letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(1))
    bits = np.unpackbits(mix(seeds).view(np.uint8).reshape(len(letters), -1), axis=1)
    return (bits.astype(np.int8) * 2 - 1)[:, :DIMENSIONS]


def _letters(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alphabet of the block (the blank first), the place of every character in it with a
    blank before and after each text, so that a lone letter makes a triple, and its row."""
    points = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])[block.offsets]
    present = np.flatnonzero(np.bincount(points, minlength=1))
    lowered = np.zeros(len(present), np.int64)
    for i, point in enumerate(present.tolist()):
        low = chr(point).lower()[:1]
        lowered[i] = ord(low) if low.isalpha() else 0
    alphabet, place = np.unique(np.append(lowered, 0), return_inverse=True)
    table = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int32)
    table[present] = place[:-1]
    lengths = np.diff(ends)
    row = np.repeat(np.arange(len(block), dtype=np.int32), lengths + 2)
    codes = np.zeros(len(row), np.int32)
    codes[np.arange(len(points)) + np.repeat(2 * np.arange(len(block)) + 1, lengths)] = table[points]
    return alphabet, codes, row


def _triples(codes: np.ndarray, row: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Key and row of the triples that hold a letter, ``SLICE`` characters at a time."""
    for at in range(0, len(codes) - 2, SLICE):
        own, rows = codes[at:at + SLICE + 2].astype(np.int64), row[at:at + SLICE + 2]
        first, second, third = own[:-2], own[1:-1], own[2:]
        good = (rows[:-2] == rows[2:]) & ((first | second | third) > 0)
        yield ((first * size + second) * size + third)[good], rows[:-2][good].astype(np.int64)


def _distinct(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    if size > SMALL_ALPHABET:
        return np.unique(key, return_inverse=True)
    present = np.flatnonzero(np.bincount(key, minlength=1))
    table = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    table[present] = np.arange(len(present))
    return present, table[key]


def bundled(block: Block, target: np.ndarray | None = None, targets: int | None = None
            ) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the triple vectors, and number of triples, per row of the block (or per
    ``target`` of a row). At most ``KINDS`` triple vectors exist at a time."""
    alphabet, codes, row = _letters(block)
    size, rows = len(alphabet), len(block) if targets is None else targets
    letters = letter_vectors(alphabet)
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    sums, count = np.zeros((rows, DIMENSIONS)), np.zeros(rows, np.int64)
    for key, own in _triples(codes, row, size):
        own = own if target is None else target[own]
        count += np.bincount(own, minlength=rows)
        present, place = _distinct(key, size)
        order = np.argsort(place, kind="stable") if len(present) > KINDS else None
        for low in range(0, len(present), KINDS):
            kinds = present[low:low + KINDS]
            vectors = (first[kinds // (size * size)] * second[kinds // size % size]
                       * letters[kinds % size]).astype(np.float32)
            if order is None:
                sums += weighted_rows(place, own, rows, vectors)
            else:
                a, b = np.searchsorted(place, [low, low + KINDS], sorter=order)
                sums += weighted_rows(place[order[a:b]] - low, own[order[a:b]], rows, vectors)
    return sums, count


def profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """The bundle of each language over the rows outside the held-out fold."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for block in blocks(batches):
            langs = block.rows.column(1).to_pylist()
            names = sorted(set(langs))
            of_row = np.searchsorted(np.array(names, dtype=object), np.array(langs, dtype=object))
            for name, vector in zip(names, bundled(block, of_row, len(names))[0]):
                sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(vector)],
                ["lang", "place", "value"])

    learned = docs.filter("lang IS NOT NULL AND NOT held_out").select("text", "lang")
    parts = learned.mapInArrow(run, "lang string, place int, value double")
    rows = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    out: dict[str, np.ndarray] = {}
    for lang, place, value in zip(rows["lang"], rows["place"], rows["value"]):
        out.setdefault(lang, np.zeros(DIMENSIONS))[place] = value
    return out


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document; the score is the cosine
    with the winning profile, at least 0."""
    marked = with_fold(docs.select("doc_id", "text", "lang"))
    learned = profiles(marked)
    langs = sorted(lang for lang, v in learned.items() if np.linalg.norm(v) > 0)
    matrix = np.array([learned[lang] / np.linalg.norm(learned[lang]) for lang in langs], np.float32)
    name = ship(docs.sparkSession, "profiles", {"matrix": matrix.reshape(-1, DIMENSIONS)}, langs=langs)

    def run(batches):
        arrays, facts = arrive(name)
        names = np.array([*facts["langs"], UNKNOWN], object)
        for block in blocks(batches):
            sums, count = bundled(block)
            lengths = np.linalg.norm(sums, axis=1)
            cosines = sums @ arrays["matrix"].T / np.where(lengths == 0, 1, lengths)[:, None]
            none = len(names) == 1
            best = np.full(len(block), len(names) - 1) if none else np.where(
                count == 0, len(names) - 1, cosines.argmax(1))
            score = np.zeros(len(block)) if none else np.where(
                best == len(names) - 1, 0.0, np.clip(cosines.max(1), 0.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), block.rows.column(1), pa.array(names[best], pa.string()),
                 pa.array(score.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.select("doc_id", "held_out", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

