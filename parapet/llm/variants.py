r"""Spelling variants: words that are one edit apart, compared in dense tiles.

Words are the runs of letters of the corpus with their counts. For two words whose longer
one has L code points, the common prefix c and the common suffix d of padded code-point
matrices tell a single edit: they differ by one inserted, deleted or replaced code point
exactly if c + d >= L - 1. The edit then lies in one piece of ``piece`` code points, and
the words agree before and behind it. So a word is dealt to one bucket per piece, named by
everything outside the piece, and again as the shorter word of a pair (L is one more).
Buckets are cut into blocks, and every pair of blocks of a bucket is compared at once. A
pair counts in the bucket of the piece in which its common prefix ends, so it counts once
although it may meet in several; tasks return a count and a best partner per word, never
pairs.

The words of a bucket differ in a window of two code points only, out of 90 letters, so a
bucket holds at most 90**2 + 90 words whatever the corpus; words of more than 64 code points
have 32 pieces, wider ones, to keep the number of rows per word bounded.

Defined cases: a null or empty text has no words; a null id counts as an empty one in the
hash; repeated rows count again; a word without near words has itself as its root; other
columns are not read; an empty table gives no rows. Very long runs are words like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parapet.llm.shared import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
CUT_EVERY = 199
PIECE, MOST_PIECES = 2, 32
BLOCK = 128
CELLS = 4_000_000  # code points compared at once
ROWS, BYTES = 16_384, 8 << 20  # rows, or bytes of words, that are taken together


def runs(docs: DataFrame) -> DataFrame:
    """``word`` per run of letters, lower-cased; the run loses a code point where the hash
    of id and run says so. Runs that are too short before are too short after."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    hashed = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    return hashed.select(F.when(F.col("h") % CUT_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of enough code points that occur often enough."""
    return (runs(docs).filter(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least))


def dealt(words: DataFrame) -> DataFrame:
    """``key, longer, piece, width, word, n``: each word in all its buckets.

    ``longer`` is the length of the longer word of the pairs that the bucket is for.
    """
    longer = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer"))
    wide = longer.withColumn("width", F.greatest(F.lit(PIECE), F.ceil(F.col("longer") / MOST_PIECES).cast("int")))
    pieces = wide.withColumn("piece", F.explode(F.sequence(
        F.lit(0), F.ceil(F.col("longer") / F.col("width")).cast("int") - 1)))
    before = F.col("piece") * F.col("width")
    behind = F.col("longer") - F.least(before + F.col("width"), F.col("longer"))
    key = F.xxhash64("longer", "piece", F.substr("word", F.lit(1), before),
                     F.substr("word", F.length("word") - behind + 1))
    return pieces.select(key.alias("key"), "longer", "piece", "width", "word", "n")


class _Rows:
    """Sorted rows of whole buckets: the words as bytes (every letter is one of Latin-1)."""

    def __init__(self, table: pa.Table) -> None:
        self.words = table.column("word").to_pylist()
        self.n = table.column("n").to_numpy()
        self.longer, self.piece, self.width = (
            table.column(c).to_numpy().astype(np.int64) for c in ("longer", "piece", "width"))
        self.data = np.frombuffer("".join(self.words).encode("latin-1"), np.uint8)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        order = sorted(range(len(self.words)), key=lambda i: (-self.n[i], self.words[i]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.at_rank = np.array(order, np.int64)
        self.near = np.zeros(len(order), np.int64)
        self.best = np.full(len(order), len(order), np.int64)

    def matrix(self, index: np.ndarray, width: int, pad: int, reverse: bool) -> np.ndarray:
        """The words at ``index`` (-1: none) as rows of code points, padded at the end."""
        flat = index.ravel()
        long = np.where(flat >= 0, self.length[flat], 0)
        out = np.full((len(flat), width), pad, np.uint8)
        row = np.repeat(np.arange(len(flat)), long)
        step = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
        begin, end = self.begin[flat][row], (self.begin + self.length)[flat][row] - 1
        out[row, step] = self.data[end - step if reverse else begin + step]
        return out.reshape(*index.shape, width)

    def compare(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """Every word of a left block with every word of the right block beside it.

        ``left`` and ``right`` are (tiles, rows) of places, -1 where a block is not full;
        ``same``: the blocks are equal, so every pair is seen from both sides anyway.
        """
        width = int(max(self.length[left].max(), self.length[right].max())) + 1
        # unequal pads: two rows always differ at last where one of them ends
        common = [(self.matrix(left, width, 0, r)[:, :, None, :] != self.matrix(right, width, 1, r)[:, None, :, :])
                  .argmax(-1) for r in (False, True)]
        long = np.maximum(self.length[left][:, :, None], self.length[right][:, None, :])
        longer, piece, wide = (v[left[:, 0]][:, None, None] for v in (self.longer, self.piece, self.width))
        near = ((left >= 0)[:, :, None] & (right >= 0)[:, None, :] & (long == longer)
                & (common[0] + common[1] >= longer - 1) & (common[0] // wide == piece))
        if same:
            near &= ~np.eye(left.shape[1], dtype=bool)[None]
        last = len(self.words)
        for own, other, axis in ((left, right, 2),) if same else ((left, right, 2), (right, left, 1)):
            rank = np.where(other >= 0, self.rank[other], last)
            best = np.where(near, rank[:, None, :] if axis == 2 else rank[:, :, None], last).min(axis)
            count = near.sum(axis)
            found = count > 0
            np.add.at(self.near, own[found], count[found])
            np.minimum.at(self.best, own[found], best[found])

    def result(self) -> pa.RecordBatch:
        found = np.flatnonzero(self.near)
        best = self.at_rank[self.best[found]]
        return pa.RecordBatch.from_arrays([
            pa.array([self.words[i] for i in found], pa.string()), pa.array(self.near[found]),
            pa.array([self.words[i] for i in best], pa.string()), pa.array(self.n[best])],
            ["word", "near", "best", "best_n"])


def _tiles(rows: _Rows, first: np.ndarray, size: np.ndarray) -> None:
    """Compare all buckets: small ones many at a time, large ones by pairs of blocks."""
    side = 2
    while side <= BLOCK:  # buckets of more than side / 2 and up to side words
        own = np.flatnonzero((size > side // 2) & (size <= side) & (size > 1))
        own = own[np.argsort(rows.length[first[own]], kind="stable")]
        while len(own):
            fits = lambda count: max(1, CELLS // (side * side * (int(rows.length[first[own[count - 1]]]) + 2)))
            some = min(fits(1), len(own))  # as many as the longest of them allows
            some = min(fits(some), some)
            part, own = own[:some], own[some:]
            index = first[part][:, None] + np.arange(side)
            index = np.where(np.arange(side) < size[part][:, None], index, -1)
            if some == 1:
                _blocks(rows, first[part[0]], size[part[0]])
            else:
                rows.compare(index, index, True)
        side *= 2
    for bucket in np.flatnonzero(size > BLOCK):
        _blocks(rows, first[bucket], size[bucket])


def _blocks(rows: _Rows, first: int, size: int) -> None:
    width = int(rows.length[first:first + size].max()) + 1
    step = int(max(1, min(BLOCK, (CELLS / width) ** 0.5)))
    starts = np.arange(first, first + size, step)
    blocks = [np.where(s + np.arange(step) < first + size, s + np.arange(step), -1)[None] for s in starts]
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            rows.compare(left, right, right is left)


def _whole_buckets(batches) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole buckets of sorted rows, with the place of each bucket's first row."""
    held, size, weight = [], 0, 0
    names = ("key", "longer", "piece")

    def cut(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(c).to_numpy() for c in names]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        first = np.flatnonzero(new)
        end = table.num_rows if last else first[-1]
        return table.slice(0, end), first if last else first[:-1], table.slice(end)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size, weight = size + batch.num_rows, weight + batch.nbytes
        if size >= ROWS or weight >= BYTES:
            table, first, rest = cut(False)
            if len(first):
                yield table, first
            held = rest.to_batches()
            size, weight = 0, 0  # a bucket that goes on is cut again after as many rows
    if held:
        table, first, _ = cut(True)
        yield table, first


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of each word that has near words."""
    def run(batches):
        for table, first in _whole_buckets(batches):
            rows = _Rows(table)
            _tiles(rows, first, np.diff(np.append(first, table.num_rows)))
            yield rows.result()

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "longer", "piece"]
    found = (dealt(words).repartition(parts, "key").sortWithinPartitions(*order)
             .mapInArrow(run, "word string, near long, best string, best_n long"))
    best = F.min(F.struct((-F.col("best_n")).alias("rest"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", F.col("top.best").alias("best"), (-F.col("top.rest")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of each word that has a form: the end of its chain. Counts grow along a
    chain, so it has no circle; each pass doubles the distance."""
    roots = forms
    while True:
        above = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = stage(roots.join(above, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def grouped(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the corpus."""
    words = stage(counted(docs), "words")
    near = words.join(near_words(words), "word", "left")
    has_form = F.col("best_n") >= RATIO * F.col("n")
    near = stage(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")), "near")
    roots = _roots(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
