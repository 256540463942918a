"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to five bytes, counted over all training texts.
A byte is coded in the longest context seen; if that context has not seen the byte, its
escape is coded and the next shorter context tries, without the symbols that the longer
one has already excluded (symbol exclusion). Escape estimation is method D: a symbol seen
c times among t has (c - 1/2)/t, the escape d/2t for d distinct symbols. Below order 0 all
remaining byte values are equal. The text, lower-cased in A-Z, is preceded and closed by
the byte 0xFF, which no UTF-8 text contains. The score is the sum of log10 probabilities.

Five bytes of context and the symbol are counted in the tasks and summed by Spark; shorter
contexts are sums over longer ones, because every text begins with enough boundary bytes.
What travels to the workers is bounded, the model is not. Up to ``CAPACITY`` entries of full
length, the whole trie travels; it is mapped into memory, not read. Beyond that only the
codes of the most frequent entries travel. The counts of all orders stay in written tables,
summed from every entry, and each other gram of a text is joined with them, so a score
does not depend on ``CAPACITY``.

The plain base score needs the count of every word. The ``HOT_WORDS`` most frequent words
travel with the trie; all other words are joined with the written table of counts.

Defined cases: a null text is an empty one with the closing token only; repeated rows are
scored alike; a null id counts as the text of its checksum, the empty one; without any
training text every count is 0 and every byte is coded below order 0; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parapet.llm.blocks import LOWER, SPACED, Block, blocks, hashes, words
from parapet.llm.shared import arrive, attach, most_frequent, ship, stage

ORDER = 5
CAPACITY = 1 << 22
HOT_WORDS = 1 << 17
EDGE = 0xFF
HELD = 1 << 21
END_WORD = 0x7F4A7C15F39CC060
FOLDS, FOLD = 7, 2
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def with_fold(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.select("doc_id", (fold == FOLD).alias("held_out"), "text")


# -- counting ---------------------------------------------------------------------------

def padded(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each after ``ORDER`` boundary bytes and before one more, and the
    places of the coded bytes."""
    gap = ORDER + 1
    shift = np.arange(len(block)) * gap + ORDER
    out = np.full(len(block.data) + len(block) * gap, EDGE, np.uint8)
    lengths = np.diff(block.offsets)
    out[np.arange(len(block.data)) + np.repeat(shift, lengths)] = LOWER[block.data]
    coded = np.ones(len(out), bool)
    starts = block.offsets[:-1] + np.arange(len(block)) * gap
    coded[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return out, np.flatnonzero(coded)


def grams(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Context and symbol of each coded place, the symbol in the lowest byte."""
    out = np.zeros(len(data), np.uint64)
    for back in range(ORDER + 1):
        out[back:] |= data[:len(data) - back].astype(np.uint64) << np.uint64(8 * back)
    return out[places]


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of all tokens, and tokens per row; each text ends in one end token."""
    data = LOWER[block.data]
    found = words(block, SPACED, data)
    values = hashes(data, found.start, found.end)
    rows = np.arange(len(block))
    ends = np.full(len(block), END_WORD, np.uint64)
    return np.concatenate([values, ends]), np.concatenate([found.row, rows]), found.per_row + 1


class Tally:
    """Counts of 64-bit keys, merged when many are held."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.__init__()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts[order], first)

    def merge(self) -> None:
        keys, counts = self.take()
        self.keys, self.counts, self.held = [keys], [counts], len(keys)


def counted(docs: DataFrame) -> DataFrame:
    """``word, key, n``: counts of words (true) and of grams over the training texts."""
    def run(batches: Iterator[pa.RecordBatch]):
        tallies = {True: Tally(), False: Tally()}
        for block in blocks(batches):
            data, places = padded(block)
            tallies[False].add(grams(data, places))
            tallies[True].add(word_hashes(block)[0])
            for word, tally in tallies.items():
                if tally.held > HELD:
                    tally.merge()
                    if tally.held > HELD // 2:
                        yield from _counts(word, tally)
        for word, tally in tallies.items():
            yield from _counts(word, tally)

    parts = docs.filter("NOT held_out").select("text").mapInArrow(run, "word boolean, key long, n long")
    return parts.groupBy("word", "key").agg(F.sum("n").alias("n"))


def _counts(word: bool, tally: Tally) -> Iterator[pa.RecordBatch]:
    keys, counts = tally.take()
    for i in range(0, len(keys), 1 << 16):
        own = keys[i:i + (1 << 16)].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(own), word)), pa.array(own), pa.array(counts[i:i + (1 << 16)].astype(np.int64))],
            ["word", "key", "n"])


# -- the model --------------------------------------------------------------------------

def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing: slots with keys, and the value of the key in each slot."""
    bits = max(4, math.ceil(math.log2(max(len(keys), 1) * 1.5)))
    slots, held = np.full(1 << bits, FREE, np.uint64), np.zeros(1 << bits, values.dtype)
    waiting = np.arange(len(keys))
    at = slot_of(keys, bits)
    while len(waiting):
        here = at[waiting]
        free = slots[here] == FREE
        slots[here[free]] = keys[waiting[free]]
        won = slots[here] == keys[waiting]
        held[here[won]] = values[waiting[won]]
        waiting = waiting[~won]
        at[waiting] = (at[waiting] + 1) & ((1 << bits) - 1)
    return slots, held


def slot_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def find(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where there is none."""
    mask, bits = len(slots) - 1, (len(slots) - 1).bit_length()
    at = slot_of(keys, bits)
    held = slots[at]
    out = np.where(held == keys, at, -1)
    open_ = np.flatnonzero((held != keys) & (held != FREE))
    while len(open_):
        at[open_] = (at[open_] + 1) & mask
        held = slots[at[open_]]
        good = held == keys[open_]
        out[open_[good]] = at[open_[good]]
        open_ = open_[~good & (held != FREE)]
    return out


def find_sorted(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in sorted keys, -1 where there is none."""
    if not len(held):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return np.where(held[at] == keys, at, -1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def compile_trie(keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Tables of the trie.

    Full-length entries, which code nearly every byte, are a hash table of log10
    probabilities; shorter entries and all contexts are sorted. ``low_total`` and
    ``low_distinct`` of a context are what its next shorter context holds besides the
    symbols seen here: the symbols of a context are symbols of every shorter one, so
    exclusion needs nothing else.
    """
    levels = {ORDER: (keys, counts)}
    for order in range(ORDER - 1, -1, -1):
        mask = np.uint64((1 << (8 * (order + 1))) - 1)
        levels[order] = _summed(levels[order + 1][0] & mask, levels[order + 1][1])
    arrays: dict[str, np.ndarray] = {}
    totals = {}
    for order in range(ORDER + 1):
        keys, counts = levels[order]
        contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.bincount(where, weights=counts, minlength=len(contexts))
        distinct = np.bincount(where, minlength=len(contexts)).astype(np.float64)
        totals[order] = (contexts, total, distinct)
        arrays |= {f"contexts{order}": contexts, f"total{order}": total.astype(np.float32),
                   f"distinct{order}": distinct.astype(np.float32)}
        if order:
            low_keys, low_counts = levels[order - 1]
            low_contexts, low_total, low_distinct = totals[order - 1]
            below = np.uint64((1 << (8 * order)) - 1)
            same = low_counts[np.searchsorted(low_keys, keys & below)]
            shorter = np.searchsorted(low_contexts, contexts & (below >> np.uint64(8)))
            left = low_total[shorter] - np.bincount(where, weights=same, minlength=len(contexts))
            arrays[f"low_total{order}"] = left.astype(np.float32)
            arrays[f"low_distinct{order}"] = (low_distinct[shorter] - distinct).astype(np.float32)
        log_counts = np.log10(counts - 0.5)
        if order == ORDER:
            slots, whole = hash_table(keys, (log_counts - np.log10(total)[where]).astype(np.float32))
            arrays |= {"slots": slots, "whole": whole}
        else:
            arrays |= {f"keys{order}": keys, f"symbol{order}": log_counts.astype(np.float32)}
    return arrays


def code(trie: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's symbol in its context."""
    out = np.zeros(len(keys))
    symbols = len(trie["keys0"])
    if not symbols:
        return np.full(len(keys), -math.log10(256))
    place = find(trie["slots"], keys)
    seen = place >= 0
    out[seen] = trie["whole"][place[seen]]
    left = np.flatnonzero(~seen)
    # what the context above leaves to this one; a negative total: no context above was seen
    total, distinct = np.full(len(left), -1.0), np.zeros(len(left))
    for order in range(ORDER, -1, -1):
        if not len(left):
            return out
        own = keys[left] & np.uint64((1 << (8 * (order + 1))) - 1)
        context = find_sorted(trie[f"contexts{order}"], own >> np.uint64(8))
        known = context >= 0
        plain = known & (total < 0)
        total[plain] = trie[f"total{order}"][context[plain]]
        distinct[plain] = trie[f"distinct{order}"][context[plain]]
        if order < ORDER:
            place = find_sorted(trie[f"keys{order}"], own)
            seen = place >= 0
            out[left[seen]] += trie[f"symbol{order}"][place[seen]] - np.log10(total[seen])
            left, context, known = left[~seen], context[~seen], known[~seen]
            total, distinct = total[~seen], distinct[~seen]
        escaping = known & (distinct > 0)
        out[left[escaping]] += np.log10(distinct[escaping] / (2 * total[escaping]))
        if order:
            total[known] = trie[f"low_total{order}"][context[known]]
            distinct[known] = trie[f"low_distinct{order}"][context[known]]
            total[~known] = -1.0
    out[left] -= math.log10(max(256 - symbols, 1))
    return out


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    return (np.asarray(table.column(0).combine_chunks()).view(np.uint64),
            np.asarray(table.column(1).combine_chunks()))


def _suffix(key, order: int):
    """Context of the given order and symbol at the end of a key."""
    return key.bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1).cast("long"))


def context_tables(entries: DataFrame) -> list[DataFrame]:
    """``context, total, distinct, symbols`` for every context of each order, written.

    ``entries`` holds all counted grams of full length. ``symbols`` maps at most 256 symbols
    to their counts. From order 1, ``low_total`` and ``low_distinct`` as in ``compile_trie``.
    """
    tables: list[DataFrame] = []
    for order in range(ORDER, -1, -1):
        tables.insert(0, stage(entries.groupBy(F.shiftright("key", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("distinct"),
            F.map_from_entries(F.collect_list(F.struct(_suffix(F.col("key"), 0), "n"))).alias("symbols")),
            f"ppm-order{order}"))
        if order:
            longer = tables[0].select("context", F.explode("symbols").alias("symbol", "n"))
            key = F.shiftleft("context", 8).bitwiseOR(F.col("symbol"))
            entries = longer.groupBy(_suffix(key, order - 1).alias("key")).agg(F.sum("n").alias("n"))
    for order in range(ORDER, 0, -1):
        # at most 256 contexts have the same shorter one
        low = tables[order - 1].select(
            F.col("context").alias("low"), F.col("total").alias("low_all"),
            F.col("distinct").alias("low_kinds"), F.col("symbols").alias("low_symbols"))
        shorter = _suffix(F.col("context"), order - 2) if order > 1 else F.shiftright("context", 8)
        same = F.aggregate(F.map_keys("symbols"), F.lit(0).cast("long"),
                           lambda s, symbol: s + F.col("low_symbols")[symbol])
        tables[order] = tables[order].join(low, shorter == F.col("low")).select(
            *tables[order].columns, (F.col("low_all") - same).alias("low_total"),
            (F.col("low_kinds") - F.col("distinct")).alias("low_distinct"))
    return tables


def coded(missed: DataFrame, tables: list[DataFrame], symbols: int) -> DataFrame:
    """Distinct grams (``key`` and other columns) with ``log``, as ``code`` computes it.

    Each order joins only the grams that no longer context has coded. Contexts of orders 0
    and 1 are at most 257 rows and joined by broadcast.
    """
    others = missed.columns
    parts, left = [], missed.select(
        *others, F.lit(0.0).alias("log"), F.lit(None).cast("long").alias("total"),
        F.lit(None).cast("long").alias("distinct"))
    for order in range(ORDER, -1, -1):
        table = tables[order].select(
            "context", F.col("total").alias("all"), F.col("distinct").alias("kinds"), "symbols",
            *([F.col("low_total"), F.col("low_distinct")] if order else
              [F.lit(None).cast("long").alias("low_total"), F.lit(None).cast("long").alias("low_distinct")]))
        own = left.join(table if order > 1 else F.broadcast(table),
                        F.shiftright(_suffix(F.col("key"), order), 8) == F.col("context"), "left")
        total, distinct = F.coalesce("total", "all"), F.coalesce("distinct", "kinds")
        n = F.col("symbols")[_suffix(F.col("key"), 0)]
        step = F.when(n.isNotNull(), F.log10(n - 0.5) - F.log10(total)).when(
            F.col("context").isNotNull() & (distinct > 0), F.log10(distinct / (2 * total))).otherwise(0.0)
        here = stage(own.select(
            *others, (F.col("log") + step).alias("log"), F.col("low_total").alias("total"),
            F.col("low_distinct").alias("distinct"), n.isNotNull().alias("seen")), "ppm-coded")
        parts.append(here.filter("seen").select(*others, "log"))
        left = here.filter("NOT seen").drop("seen")
    out = left.select(*others, (F.col("log") - math.log10(max(256 - symbols, 1))).alias("log"))
    for part in parts:
        out = out.unionByName(part)
    return out


def train(docs: DataFrame, capacity: int = CAPACITY, hot_words: int = HOT_WORDS):
    """The shipped model, the table of word counts and, unless all grams travel, the tables
    of contexts. ``docs`` comes from ``with_fold``."""
    counts = stage(counted(docs), "ppm-counts")
    grams_table = counts.filter("NOT word").select("key", "n")
    whole = grams_table.count() <= capacity
    if whole:
        tables, arrays = [], compile_trie(*_columns(grams_table))
    else:
        tables = context_tables(grams_table)
        hot = most_frequent(grams_table, "n", capacity).join(
            tables[ORDER].select("context", "total"), F.shiftright("key", 8) == F.col("context"))
        keys, logs = _columns(hot.select("key", (F.log10(F.col("n") - 0.5) - F.log10("total")).cast("float")))
        slots, held = hash_table(keys, logs)
        arrays = {"slots": slots, "whole": held}
    words_table = counts.filter("word").select("key", "n")
    tokens, kinds = words_table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot, hot_n = _columns(most_frequent(words_table, "n", hot_words).select("key", "n"))
    slots, held = hash_table(hot, hot_n)
    arrays |= {"word_slots": slots, "word_counts": held}
    facts = {"tokens": int(tokens), "kinds": int(kinds), "all_hot": bool(kinds == len(hot)), "whole": whole}
    return ship(docs.sparkSession, "ppm", arrays, **facts), words_table, tables, facts


def looked_up(model: dict[str, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams that travel (0 for others), and the places of the others."""
    place = find(model["slots"], keys)
    codes = model["whole"][np.maximum(place, 0)].astype(np.float64)
    return np.where(place >= 0, codes, 0.0), np.flatnonzero(place < 0)


def per_row(keys: np.ndarray, rows: np.ndarray, count: int) -> pa.ListArray:
    """Distinct keys of each row with their number."""
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(fresh)
    times = np.diff(np.append(first, len(keys)))
    stops = np.bincount(rows[first], minlength=count).cumsum()
    pairs = pa.StructArray.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(times, pa.int64())], ["key", "times"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pairs)


# -- scoring ----------------------------------------------------------------------------

def scored(docs: DataFrame, capacity: int = CAPACITY, hot_words: int = HOT_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    marked = with_fold(docs)
    name, words_table, tables, facts = train(marked, capacity, hot_words)
    tokens, floor = facts["tokens"], math.log10(facts["tokens"] + facts["kinds"] + 1)
    whole = facts["whole"]

    def run(batches):
        model, _ = arrive(name)
        for block in blocks(batches):
            data, places = padded(block)
            keys = grams(data, places)
            bits, missed = (code(model, keys), np.zeros(0, int)) if whole else looked_up(model, keys)
            bounds = block.offsets[:-1] + np.arange(len(block))
            gram_row = np.searchsorted(bounds, missed, side="right") - 1
            values, row, tokens_per_row = word_hashes(block)
            place = find(model["word_slots"], values)
            hot = place >= 0
            n = np.where(hot, model["word_counts"][np.maximum(place, 0)], 0)
            base = np.bincount(row, weights=np.log10(n + 1.0), minlength=len(block))
            known = np.bincount(row, weights=hot, minlength=len(block)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                block.rows.column(0), block.rows.column(1), pa.array(tokens_per_row, pa.int64()), pa.array(known),
                pa.array(base), pa.array(np.add.reduceat(bits, bounds)),
                per_row(values[~hot], row[~hot], len(block)), per_row(keys[missed], gram_row, len(block))],
                ["doc_id", "held_out", "n_tokens", "known", "base", "coded", "rest", "missed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = "array<struct<key:long,times:long>>"
    rows = marked.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, "
                                  f"coded double, rest {pairs}, missed {pairs}")
    if not (facts["all_hot"] and whole):  # otherwise nothing is outside: nothing to join
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "ppm-first")
    pick = lambda name: rows.select("row", F.inline(name))
    more = missing = None
    if not facts["all_hot"]:
        more = pick("rest").join(words_table, "key").groupBy("row").agg(
            F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    if not whole:
        symbols = tables[0].select("distinct").first()[0]
        logs = stage(coded(pick("missed").groupBy("key").agg(F.count("*").alias("size")), tables, symbols), "ppm-logs")
        missing = attach(pick("missed"), logs, "key", "size").groupBy("row").agg(
            F.sum(F.col("times") * F.col("log")).alias("missing"))
    rows = rows.join(more, "row", "left") if more is not None else rows.withColumns(
        {"more": F.lit(0), "gain": F.lit(0.0)})
    rows = rows.join(missing, "row", "left") if missing is not None else rows.withColumn("missing", F.lit(0.0))
    summed = F.col("base") + F.coalesce("gain", F.lit(0.0))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                       F.lit(tokens).cast("long").alias("train_tokens"),
                       (summed - F.col("n_tokens") * floor).alias("base_score"),
                       (F.col("coded") + F.coalesce("missing", F.lit(0.0))).alias("score"))
