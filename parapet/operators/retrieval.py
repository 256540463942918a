"""Nearest chunks by cosine similarity.

Vectors are compared block against block: a group is one slab of the store and one block
of the queries, both of bounded size, and emits only its best ``k`` per query. No pair
table is ever built. The number of slabs and blocks follows from row counts, so a cell
that holds a third of all rows is cut into as many groups as it needs. Scores are made in
tiles, so a task holds one slab, one block and one tile. Single precision picks the pairs
whose score may count, with a margin for its error; these are scored in double precision.
Vectors that are multiples of whole numbers, as counts of terms are, need no single precision:
their products are whole, and several queries share one product of doubles.

A search is a function of queries, store and k (``Search``). Exact search (``nearest``) meets
every item, in rounds: a query takes its best hits so far along, and slabs emit only what
beats them. Search in trained cells (``CellSearch``) deals the items to the nearest of a set
of centres and looks into as many cells around a query as the wanted recall takes; that
number is measured on the store at hand. Scores are exact in both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from parapet.session import shared_folder

SLAB_ROWS = 50_000
BLOCK_ROWS = 32_768
TILE_QUERIES, TILE_ITEMS = 1_024, 512  # scores that are in memory at once
PAIRS = 65_536  # pairs that are scored again at once
WHOLE_QUERIES, WHOLE_ITEMS = 4_096, 256  # a tile of whole numbers
WHOLE_SPREAD = 0.95  # length of its shortest item by that of its longest
WHOLE_LENGTH, WHOLE_SHARE = 256, 8  # longest vector of whole numbers, and largest number its least entry may stand for
WHOLE_BITS = 52  # bits of a double that hold sums of whole numbers
SEED_ITEMS = 1_024  # items that queries without hits meet first
ROUND_SLABS, ROUND_ITEMS, ROUND_GROWTH = 8, 50_000, 8  # most slabs and items of the first round, and how many times more the next one has met
WORTHWHILE_ROWS = 2_000  # below this size a slab is not split just to use more cores
PLACES = 9  # similarities are ranked at this many decimal places, ties by id


def similarity(cosine: Column) -> Column:
    """Map a cosine to 0..1; rounding errors outside are cut off."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + cosine) / 2))


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1 if len(array) else 1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    matrix = _lists(column).astype(np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _order(row: np.ndarray, place: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Order by row, falling score and place; as one whole number where that has room."""
    if len(row) and np.abs(score).max() <= 1:
        bits = int(place.max()).bit_length()
        if int(row.max()).bit_length() + 31 + bits <= 63:
            behind = np.rint((1 - score) * 10.0 ** PLACES).astype(np.int64)  # scores are rounded
            return np.argsort((row << 31 | behind) << bits | place)
    return np.lexsort((place, -score, row))


def _merged(row: np.ndarray, place: np.ndarray, score: np.ndarray, rows: int, k: int):
    """The best ``k`` per row, equal scores by place, and the score a row's next hit must
    reach: its last one, or minus infinity while it has fewer than ``k``."""
    order = _order(row, place, score)
    row, place, score = row[order], place[order], score[order]
    first = np.searchsorted(row, np.arange(rows))
    keep = np.arange(len(row)) - first[row] < k
    row, place, score = row[keep], place[keep], score[keep]
    count = np.bincount(row, minlength=rows)
    bar, full = np.full(rows, -np.inf), count == k
    bar[full] = score[np.cumsum(count)[full] - 1]
    return row, place, score, bar


def _whole(unit: np.ndarray):
    """Rows of unit length as vectors of whole numbers with the same direction, and the lengths
    of these; the length is 0 where there is no such vector of moderate length.

    Counts of terms that were scaled to length one are such rows: their smallest entry stands
    for a small number.
    """
    numbers, length = np.zeros_like(unit), np.zeros(len(unit))
    size = np.abs(unit)
    smallest = np.where(size > 0, size, np.inf).min(axis=1, initial=np.inf)
    left = np.flatnonzero(np.isfinite(smallest))
    for share in range(1, WHOLE_SHARE + 1):
        scaled = unit[left] * (share / smallest[left])[:, None]
        rounded = np.rint(scaled)
        fits = np.abs(scaled - rounded).max(axis=1, initial=0) <= 1e-9
        numbers[left[fits]] = rounded[fits]
        left = left[~fits]
        if not len(left):
            break
    length = np.sqrt((numbers * numbers).sum(axis=1))
    length[length > WHOLE_LENGTH] = 0
    return numbers, length


def _top(store: np.ndarray, wanted: np.ndarray, k: int, allowed=None, least: np.ndarray | None = None, whole=None):
    """Rows, places and rounded scores of the best ``k`` of the store per row of ``wanted``.

    ``allowed(rows, places)`` says which pairs count; scores below ``least`` of their row do
    not matter. Pairs of whole numbers (``_whole``, for the store in ``whole``) are compared
    as such, the others in single precision.
    """
    seeds = max(SEED_ITEMS, 4 * k)
    if allowed is not None or len(store) < 2 * seeds or not len(wanted):
        return _top_single(store, wanted, k, allowed, least)
    numbers, length = whole if whole is not None else _whole(store)
    if 2 * np.count_nonzero(length) < len(store):
        return _top_single(store, wanted, k, None, least)
    asked, asked_length = _whole(wanted)
    apart, own = np.flatnonzero(asked_length == 0), np.flatnonzero(asked_length)
    low = np.full(len(wanted), -np.inf) if least is None else least
    first, later = np.flatnonzero(length == 0), np.flatnonzero(length)
    if np.isneginf(low[own]).any():
        taken = np.linspace(0, len(later) - 1, min(seeds, len(later))).astype(np.int64)
        first, later = np.sort(np.concatenate([first, later[taken]])), np.delete(later, taken)
    out = []
    if len(apart):
        row, place, score = _top_single(store, wanted[apart], k, None, low[apart])
        out.append((apart[row], place, score))
    if len(own):
        row, place, score = (_top_single(store[first], wanted[own], k, None, low[own]) if len(first)
                             else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))
        row, place, score = _top_whole(store, wanted[own], k, low[own], (numbers, length, later),
                                       (asked[own], asked_length[own]), (row, first[place], score))
        out.append((own[row], place, score))
    return _merged(*[np.concatenate(parts) for parts in zip(*out)], len(wanted), k)[:3]


def _top_whole(store, wanted, k: int, low: np.ndarray, items, queries, found):
    """``_top`` for whole numbers: ``items`` are numbers, lengths and the places to meet,
    ``queries`` numbers and lengths, ``found`` the hits so far.

    A product of two such rows is a whole number, so several queries share the bits of one
    double, each with a field wide enough for its products. A field also holds what its
    product lacks to the least that may count, so that its highest bit is set if and only if
    the product reaches that. Both sides are met in order of length: a tile takes the
    shortest length of its items as theirs, which lets a few pairs more through. These are
    scored in double precision.
    """
    numbers, length, later = items
    later = later[np.argsort(-length[later], kind="stable")]
    length, met = length[later], np.ones((len(later), numbers.shape[1] + 1))
    met[:, :-1] = numbers[later]
    asked, asked_length = queries
    cuts = _cuts(length)
    signed = bool((met < 0).any() or (asked < 0).any())
    row, place, score, bar = _merged(*found[:1], *found[1:], len(wanted), k)
    order, out = np.argsort(asked_length, kind="stable"), []
    tile_size = WHOLE_QUERIES * WHOLE_ITEMS
    room, marks, near = (np.empty(tile_size, kind) for kind in (np.float64, np.int64, bool))
    begun = np.searchsorted(row, np.arange(len(wanted) + 1))
    for start in range(0, len(order), WHOLE_QUERIES):
        some = order[start:start + WHOLE_QUERIES]
        mine = np.concatenate([np.arange(begun[i], begun[i + 1]) for i in some])
        own = np.repeat(np.arange(len(some)), begun[some + 1] - begun[some])
        best, floor = (own, place[mine], score[mine]), np.maximum(bar[some], low[some])
        vectors, lengths, rows = wanted[some], asked_length[some], asked[some]
        packed, waiting, held, reach = {}, [], 0, None
        for begin, end in zip(cuts, cuts[1:]):
            tile, longest, shortest = met[begin:end], length[begin], length[end - 1]
            if reach is None:  # per unit of the items' length; rounding and ``_whole`` change less than 1e-7
                reach = (np.where(np.isneginf(floor), -1.0, floor) - 1e-7) * lengths
                negative, far, gap = (reach < 0).any(), np.abs(reach).max(), (lengths - reach).max()
            enough = np.ceil(reach * (np.where(reach < 0, longest, shortest) if negative else shortest) - 1e-6)
            low_side = (lengths.max() * longest if signed else 0) + far * longest
            high_side = gap * longest + far * (longest - shortest)
            bits = 1 + int(np.ceil(np.log2(max(low_side, high_side) + 4)))
            fields = WHOLE_BITS // bits
            if bits not in packed:
                packed[bits] = _fields(rows, fields, bits)
            sides, shift = packed[bits]
            lack = np.zeros(sides.shape[0] * fields)
            lack[:len(some)] = 2.0 ** (bits - 1) - enough
            sides[:, -1] = 2.0 ** WHOLE_BITS + lack.reshape(-1, fields) @ shift
            pairs = len(sides) * len(tile)
            sums = np.matmul(sides, tile.T, out=room[:pairs].reshape(-1, len(tile))).view(np.int64).reshape(-1)
            highest = bits * np.arange(1, fields + 1) - 1
            np.not_equal(np.bitwise_and(sums, (1 << highest).sum(), out=marks[:pairs]), 0, out=near[:pairs])
            found = _marked(near, pairs)
            if not len(found):
                continue
            field, at = np.nonzero(marks[found] >> highest[:, None] & 1)
            group, c = np.divmod(found[at], len(tile))
            r = group * fields + field
            beyond = sums[found[at]] >> (bits * field) & ((1 << bits - 1) - 1)
            rough = (beyond + enough[r]) / (lengths[r] * length[begin + c])
            keep = rough >= floor[r] - 1e-7
            waiting.append((r[keep], later[begin + c[keep]]))
            held += len(waiting[-1][0])
            if held >= k * len(some):
                best, last = _better(vectors, store, k, floor, best, waiting)
                floor, waiting, held, reach = np.maximum(last, low[some]), [], 0, None
        own, at, value = _better(vectors, store, k, floor, best, waiting)[0] if held else best
        out.append((some[own], at, value))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _marked(near: np.ndarray, rows: int) -> np.ndarray:
    """Places of the few true values among the first ``rows``; the array has room for eights."""
    near[rows:rows + -rows % 8] = False
    words = np.flatnonzero(near[:rows + -rows % 8].view(np.uint64))
    at, offset = np.nonzero(near[:rows + -rows % 8].reshape(-1, 8)[words])
    return words[at] * 8 + offset


def _better(asked: np.ndarray, store: np.ndarray, k: int, floor: np.ndarray, best, waiting):
    """The best ``k`` per row of the hits so far and of pairs that wait to be scored, and the
    last scores."""
    row, place = (np.concatenate(parts) for parts in zip(*waiting))
    value = _products(asked, store, row, place)
    keep = value >= floor[row]
    *best, bar = _merged(*[np.concatenate(p) for p in zip(best, (row[keep], place[keep], value[keep]))], len(asked), k)
    return best, bar


def _cuts(length: np.ndarray) -> list[int]:
    """Where tiles of items begin, and the end: a tile has few items of nearly one length."""
    cuts = [0]
    while cuts[-1] < len(length):
        begin = cuts[-1]
        near = np.searchsorted(-length, -WHOLE_SPREAD * length[begin], "right")
        cuts.append(int(min(begin + WHOLE_ITEMS, near)))
    return cuts


def _fields(rows: np.ndarray, fields: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole numbers, so many to a row of doubles, with room for one more column; and
    the weights of the fields."""
    shift = 2.0 ** (bits * np.arange(fields))
    groups = -(-len(rows) // fields)
    padded = np.zeros((groups * fields, rows.shape[1]))
    padded[:len(rows)] = rows
    sides = np.zeros((groups, rows.shape[1] + 1))
    sides[:, :-1] = np.einsum("gfd,f->gd", padded.reshape(groups, fields, -1), shift)
    return sides, shift


def _products(asked: np.ndarray, store: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rounded scores of some pairs."""
    out = np.empty(len(row))
    for i in range(0, len(row), PAIRS):
        out[i:i + PAIRS] = np.einsum("ij,ij->i", asked[row[i:i + PAIRS]], store[place[i:i + PAIRS]])
    return np.round(out, PLACES)


def _top_single(store: np.ndarray, wanted: np.ndarray, k: int, allowed=None, least: np.ndarray | None = None):
    """``_top`` for any vectors.

    Scores are made in tiles. A tile ranks a row only while that has fewer than ``k`` hits;
    later ones are compared with its last hit and give few candidates. Tiles are in single precision: ``slack`` is twice the largest error of a product of unit
    vectors, as both a score and the hit it is compared with may be off.
    """
    out, rough = [], store.astype(np.float32)
    slack = 10.0 ** -PLACES + (wanted.shape[1] + 8) * 2.0 ** -23
    room, near = np.empty(TILE_QUERIES * TILE_ITEMS, np.float32), np.empty(TILE_QUERIES * TILE_ITEMS, bool)
    for start in range(0, len(wanted), TILE_QUERIES):
        asked = wanted[start:start + TILE_QUERIES]
        single = asked.astype(np.float32)
        low = np.full(len(asked), -np.inf) if least is None else least[start:start + TILE_QUERIES]
        best, bar = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.full(len(asked), -np.inf)
        waiting, rows = [], 0
        for begin in range(0, len(store), TILE_ITEMS):
            width, floor = min(TILE_ITEMS, len(store) - begin), np.maximum(bar, low)
            pairs = len(asked) * width
            scores = np.matmul(single, rough[begin:begin + width].T, out=room[:pairs].reshape(-1, width))
            fresh = np.flatnonzero(np.isneginf(floor))
            if len(fresh):
                part = scores[fresh]
                if allowed is not None:
                    part[~allowed((start + fresh)[:, None], np.arange(begin, begin + width)[None, :])] = -np.inf
                    scores[fresh] = part
                if width > k:
                    floor[fresh] = np.partition(part, width - k, axis=1)[:, width - k]
            np.greater_equal(scores, (floor - slack).astype(np.float32)[:, None], out=near[:pairs].reshape(-1, width))
            r, c = np.divmod(np.flatnonzero(near[:pairs]), width)
            if allowed is not None and len(fresh):
                keep = ~np.isneginf(scores[r, c])
                r, c = r[keep], c[keep]
            value = _scored(asked, store[begin:begin + TILE_ITEMS], r, c)
            keep = (value > bar[r]) & (value >= low[r])
            r, c, value = r[keep], c[keep], value[keep]
            if allowed is not None and len(r):
                keep = allowed(start + r, begin + c)
                r, c, value = r[keep], c[keep], value[keep]
            if len(r):
                waiting.append((r, begin + c, value))
                rows += len(r)
            if rows and (len(fresh) or rows >= k * len(asked)):
                *best, bar = _merged(*[np.concatenate(p) for p in zip(best, *waiting)], len(asked), k)
                waiting, rows = [], 0
        row, place, score, _ = _merged(*[np.concatenate(p) for p in zip(best, *waiting)], len(asked), k)
        out.append((start + row, place, score))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _scored(asked: np.ndarray, tile: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rounded scores of some pairs of a tile: the whole tile if these are many."""
    if 16 * len(row) > len(asked) * len(tile):
        return np.round((asked @ tile.T)[row, place], PLACES)
    return _products(asked, tile, row, place)


def _hits(items: pa.Table, queries: pa.Table, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({
        "query_id": queries.column("query_id").combine_chunks().take(pa.array(row, pa.int64())),
        "item_id": items.column("item_id").combine_chunks().take(pa.array(place, pa.int64())),
        "cosine": pa.array(score, pa.float64()),
    })


def _nothing(items: pa.Table, queries: pa.Table) -> pa.Table:
    return _hits(items, queries, *[np.empty(0)] * 3)


def _best(k: int, flips: int | None = None):
    """Group function: store rows against query rows, best ``k`` items per query. With
    ``flips`` a pair counts if its ``codes`` differ in up to so many bits in some table."""

    def compare(items: pa.Table, queries: pa.Table) -> pa.Table:
        if not items.num_rows or not queries.num_rows:
            return _nothing(items, queries)
        items, near = items.sort_by("item_id"), None
        if flips is not None:
            own, other = (np.ascontiguousarray(_lists(t.column("codes")).T) for t in (queries, items))

            def near(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
                met = np.zeros(np.broadcast_shapes(rows.shape, places.shape), bool)
                for a, b in zip(own, other):
                    met |= np.bitwise_count(a[rows] ^ b[places]) <= flips
                return met

        store, wanted = _matrix(items.column("vector")), _matrix(queries.column("vector"))
        return _hits(items, queries, *_top(store, wanted, k, near))

    return compare


def _best_in_cells(k: int):
    """Group function: each query meets the items of its ``cells``, best ``k`` per query."""

    def compare(items: pa.Table, queries: pa.Table) -> pa.Table:
        if not items.num_rows or not queries.num_rows:
            return _nothing(items, queries)
        items = items.sort_by("item_id")
        store, wanted = _matrix(items.column("vector")), _matrix(queries.column("vector"))
        cells = items.column("cell").to_numpy()
        by_cell = np.argsort(cells, kind="stable")
        names, first = np.unique(cells[by_cell], return_index=True)
        opened = queries.column("cells").combine_chunks()
        owner = np.repeat(np.arange(len(wanted)), opened.value_lengths().to_numpy())
        opened = opened.flatten().to_numpy()
        by_name = np.argsort(opened, kind="stable")
        owner, opened = owner[by_name], opened[by_name]
        found, bar = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], np.full(len(wanted), -np.inf)
        waiting, rows = [], 0
        for name, own in zip(names, np.split(by_cell, first[1:])):
            asked = owner[np.searchsorted(opened, name):np.searchsorted(opened, name, "right")]
            if not len(asked):
                continue
            row, place, score = _top(store[own], wanted[asked], k, least=bar[asked])
            waiting.append((asked[row], own[place], score))
            rows += len(row)
            if rows >= k * len(wanted):
                *found, bar = _merged(*[np.concatenate(p) for p in zip(found, *waiting)], len(wanted), k)
                waiting, rows = [], 0
        *found, bar = _merged(*[np.concatenate(p) for p in zip(found, *waiting)], len(wanted), k)
        return _hits(items, queries, *found)

    return compare


def _spread(df: DataFrame, own: str, own_count: str, other: str, other_count: str, row_id: str):
    """Put a row into one of its own pieces and next to every piece of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(row_id), F.col(own_count))).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1).cast("array<bigint>"))
    )


def vector_problem(vector: Column, dimensions: int) -> Column:
    """Why a vector cannot be compared, or null."""
    return (
        F.when(vector.isNull(), "no_vector")
        .when(F.size(vector) != dimensions, "wrong_length")
        .when(_no_number(vector), "no_number")
    )


def _no_number(vector: Column) -> Column:
    return F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def _common_length(sizes: DataFrame) -> int:
    """The most common ``n`` that is not null, the largest of these, or 0."""
    top = sizes.where(F.col("n").isNotNull()).groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    return top[0] if top else 0


def _size() -> Column:
    return F.when(F.col("vector").isNotNull(), F.size("vector"))


def comparable(queries: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without null vectors, vectors with null or NaN, and vectors of another
    length than the most common one of the store."""
    good = vector_problem(F.col("vector"), _common_length(store.select(_size().alias("n")))).isNull()
    return queries.where(good), store.where(good)


def _ranked(queries: DataFrame, store: DataFrame, k: int, flips: int) -> DataFrame:
    """Both sides with the number of ``slabs`` and ``blocks``, and their ``codes``: the best
    items of all pairs of groups. A pair of ids counts once."""
    items = _spread(store, "slab", "slabs", "block", "blocks", "item_id")
    asked = _spread(queries, "block", "blocks", "slab", "slabs", "query_id")
    found = _met(items.select("slab", "block", "item_id", "vector", "codes"),
                 asked.select("slab", "block", "query_id", "vector", "codes"), _best(k, flips))
    return _placed(found.groupBy("query_id", "item_id").agg(F.max("cosine").alias("cosine")), k)


def _met(items: DataFrame, asked: DataFrame, compare: Callable) -> DataFrame:
    """Slabs of the store against blocks of queries, one group a pair."""
    item_type = items.schema["item_id"].dataType.simpleString()
    return items.groupBy("slab", "block").cogroup(asked.groupBy("slab", "block")).applyInArrow(
        compare, f"query_id bigint, item_id {item_type}, cosine double")


def _placed(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(
        F.col("rank") <= k
    )


def _sizes(items: int, asked: int, cores: int, slab_rows: int, block_rows: int) -> tuple[int, int]:
    """Numbers of slabs and blocks: enough to bound their rows, and to use the cores."""
    slabs = max(-(-items // slab_rows), min(-(-items // WORTHWHILE_ROWS), cores), 1)
    return slabs, max(-(-asked // block_rows), 1)


def nearest(
    queries: DataFrame,
    store: DataFrame,
    k: int = 5,
    slab_rows: int = SLAB_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact nearest items: every slab of the store meets every block of queries.

    Both sides are written to the shared folder once. Tasks hold slabs of the store and read
    the blocks, so neither side is copied for the other. Were every slab to emit the best
    ``k`` of each query, hits would grow with the product of both sides. So the store is met
    in rounds, a few slabs first and then ``ROUND_GROWTH`` times as many items as before. A
    query takes its last hit so far along, and what does not come before that is not
    emitted: about ``k * ROUND_GROWTH`` hits per query and round, however many slabs.
    """
    spark, folder = store.sparkSession, shared_folder(store.sparkSession, "nearest")
    asked, items = f"{folder}/queries", f"{folder}/items"
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit("round"), "item_id"), 1) / F.lit(2.0 ** 63)
    later = F.floor(-F.log(F.greatest(drawn, F.lit(2.0 ** -60))) / F.log(F.lit(float(ROUND_GROWTH))))
    # Which vectors are comparable is asked of the written rows, so the store is read once.
    store = store.select("item_id", F.when(~_no_number(F.col("vector")), F.col("vector")).alias("vector"),
                         _size().alias("n"), later.cast("int").alias("later"))
    store.write.partitionBy("later").parquet(items)
    store = spark.read.schema(store.schema).parquet(items)
    length = _common_length(store)
    store = store.where((F.col("n") == length) & F.col("vector").isNotNull()).drop("n")
    queries = queries.where(vector_problem(F.col("vector"), length).isNull()).select("query_id", "vector")
    queries.write.parquet(asked)
    queries = spark.read.schema(queries.schema).parquet(asked)
    held = dict(tuple(r) for r in store.groupBy("later").count().collect())  # a few rows
    total, cores = queries.count(), spark.sparkContext.defaultParallelism
    first = max(held, default=0)
    while first and sum(n for level, n in held.items() if level >= first - 1) <= min(ROUND_SLABS * slab_rows, ROUND_ITEMS):
        first -= 1
    found = None
    for level in range(first, -1, -1):
        own = F.col("later") >= level if level == first else F.col("later") == level
        rows = sum(n for at, n in held.items() if (at >= level if level == first else at == level))
        slabs, blocks = _sizes(rows, total, cores, slab_rows, block_rows)
        bars = queries.select("*", F.lit(None).cast("double").alias("least"),
                              F.lit(None).cast(store.schema["item_id"].dataType).alias("last"))
        if found is not None:
            bars = queries.join(found.where(F.col("rank") == k).select(
                "query_id", F.col("cosine").alias("least"), F.col("item_id").alias("last")), "query_id", "left")
        bars.repartition(blocks).write.parquet(f"{folder}/asked-{level}")
        hits = store.where(own).select("item_id", "vector").repartition(slabs).mapInArrow(
            _slabs_against(f"{folder}/asked-{level}", k, slab_rows, block_rows),
            f"query_id bigint, item_id {store.schema['item_id'].dataType.simpleString()}, cosine double")
        if found is not None:
            hits = hits.unionByName(found.drop("rank"))
        found = _placed(hits, k)
        if level:
            found.write.parquet(f"{folder}/found-{level}")
            found = spark.read.schema(found.schema).parquet(f"{folder}/found-{level}")
    return found


def _blocks(folder: str, rows: int):
    """The rows of a folder of parquet files as tables of bounded size."""
    system, path = pafs.FileSystem.from_uri(folder)
    for info in sorted(system.get_file_info(pafs.FileSelector(path)), key=lambda info: info.path):
        if info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(rows):
                    yield pa.Table.from_batches([batch])


def _slabs_against(folder: str, k: int, slab_rows: int, block_rows: int):
    """Batch function: the rows of a partition, slab by slab, against all blocks of queries."""

    def meet(held: list[pa.RecordBatch]):
        items = pa.Table.from_batches(held).sort_by("item_id")
        store = _matrix(items.column("vector"))
        whole = _whole(store)
        for queries in _blocks(folder, block_rows):
            least = queries.column("least").fill_null(-np.inf).to_numpy()
            row, place, score = _top(store, _matrix(queries.column("vector")), k, least=least, whole=whole)
            hits, last = _hits(items, queries, row, place, score), queries.column("last").take(pa.array(row))
            behind = pc.and_(pa.array(score == least[row]), pc.greater(hits.column("item_id"), last))
            yield from hits.filter(pc.invert(behind.fill_null(False))).to_batches()

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= slab_rows:
                yield from meet(held)
                held, rows = [], 0
        if rows:
            yield from meet(held)

    return run


def _counted(queries: DataFrame, store: DataFrame, slab_rows: int = SLAB_ROWS, block_rows: int = BLOCK_ROWS):
    """Both sides with the numbers of slabs and blocks that follow from their rows."""
    cores = store.sparkSession.sparkContext.defaultParallelism
    slabs, blocks = _sizes(store.count(), queries.count(), cores, slab_rows, block_rows)
    counts = [F.lit(slabs).alias("slabs"), F.lit(blocks).alias("blocks")]
    return queries.select("*", *counts), store.select("*", *counts)


#: A search takes queries (``query_id, vector``), a store (``item_id, vector``) and k, and
#: returns ``query_id, item_id, cosine, rank`` of the best k items per query.
Search = Callable[[DataFrame, DataFrame, int], DataFrame]


def with_scores(ranked: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Similarity per hit. The threshold cuts after ranking and before rounding."""
    return (
        ranked.withColumn("similarity", similarity(F.col("cosine")))
        .where(F.col("similarity") >= threshold)
        .withColumn("relevance_score", F.round("similarity", 4))
    )


def similarity_search(
    queries: DataFrame, store: DataFrame, k: int = 5, threshold: float = 0.0, search: Search = nearest
) -> DataFrame:
    """Ranked hits with scores; a ``top_k`` column in ``queries`` gives each query its own k."""
    hits = with_scores(search(queries, store, k), threshold)
    if "top_k" in queries.columns:
        hits = hits.join(queries.select("query_id", "top_k"), "query_id").where(
            F.col("rank") <= F.col("top_k")
        ).drop("top_k")
    return hits


def planes(tables: int, bits: int, dimensions: int) -> np.ndarray:
    """Hyperplanes of +1 and -1, one column per bit of each table.

    The sign comes from a short integer formula, so any engine can compute the same cells.
    """
    x = np.arange(tables * bits)[None, :] * dimensions + np.arange(dimensions)[:, None] + 12_345
    mixed = x * x * x % PRIME * 48_271 % PRIME
    return np.where(mixed // 4_096 % 2 == 1, 1.0, -1.0)


PRIME = 2_147_483_647
CELL_ROWS = 512  # wanted mean number of rows in a cell


def bits_for(rows: int) -> int:
    """Enough bits that a cell keeps about ``CELL_ROWS`` rows however many there are."""
    return max(4, (max(rows, 1) // CELL_ROWS).bit_length())


def flips_for(bits: int) -> int:
    """How many planes of a table a query may lie on the other side of than an item."""
    return -(-bits // 4)


def _codes(df: DataFrame, tables: int, bits: int, dimensions: int) -> DataFrame:
    """One number per hash table: the signs of its planes."""
    normals = planes(tables, bits, dimensions)
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf(ArrayType(LongType()))
    def signs(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        above = np.round(np.stack(vectors.to_numpy()) @ normals, PLACES) > 0
        return pd.Series(list(above.reshape(len(vectors), tables, bits) @ weights))

    return df.withColumn("codes", signs(F.col("vector").cast("array<double>")))


def nearest_approx(
    queries: DataFrame,
    store: DataFrame,
    k: int = 5,
    dimensions: int = 64,
    tables: int = 8,
    bits: int | None = None,
) -> DataFrame:
    """Nearest items among those in the hash cells around the query.

    Similarities are exact; items in none of the cells are missed. The number of bits follows
    from the size of the store, and a query also opens the cells that differ in up to
    ``flips_for`` of them: so many that all the cells of a query together often hold more
    rows than the store (1.8 times as many at 7 bits, 1.1 at 13). Rows are therefore not
    copied into cells. Slabs meet blocks as in ``nearest``, each pair of rows once, and a
    pair whose score would count is tested for a shared cell. Vectors without near ones
    need many cells: see ``CellSearch``, which measures how many.
    """
    queries, store = (
        df.select(name, "vector").where(vector_problem(F.col("vector"), dimensions).isNull()).distinct()
        for df, name in ((queries, "query_id"), (store, "item_id"))
    )
    bits = bits or bits_for(store.count())
    coded = (_codes(df, tables, bits, dimensions) for df in _counted(queries, store))
    return _ranked(*coded, k, flips_for(bits))


def _unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, np.float64) for v in vectors])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows chosen by a hash of their id, at most twice as many."""
    share = min(1.0, rows / max(df.count(), 1))
    level = min(int((2 * share - 1) * 2.0 ** 63), 2 ** 63 - 1)
    return df.where(F.xxhash64(key, F.lit("sample")) <= F.lit(level)).limit(2 * rows)


def _with_cells(df: DataFrame, centres: np.ndarray, column: str, choose: Callable) -> DataFrame:
    """Rows with a column that is chosen from their products with the centres."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                chosen = choose(_unit(batch.column("vector").to_pylist()) @ centres.T)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(chosen)], [*batch.schema.names, column.split()[0]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, {column}")


def _in_cells(
    queries: DataFrame, store: DataFrame, k: int, cells: int, slab_rows: int = SLAB_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best ``k`` items per query among the items of its ``cells``.

    Cells are gathered into slabs of bounded size, and a cell beyond that size is cut into
    slabs of its own. A query goes once to every slab that holds some of its cells, with the
    names of these cells, and not once to every cell.
    """
    held = dict(tuple(r) for r in store.groupBy("cell").count().collect())  # one row per cell
    cores = store.sparkSession.sparkContext.defaultParallelism
    slabs, blocks = _sizes(sum(held.values()), queries.count(), cores, slab_rows, block_rows)
    room = -(-sum(held.values()) // slabs)
    first, pieces, last, used = [], [], 0, 0
    for rows in (held.get(cell, 0) for cell in range(cells)):
        if used and used + rows > room:
            last, used = last + 1, 0
        first.append(last)
        pieces.append(max(1, -(-rows // slab_rows)))
        last, used = last + pieces[-1] - 1, used + rows

    def start(cell: Column) -> Column:
        return F.get(F.lit(first), cell)

    def end(cell: Column) -> Column:
        return start(cell) + F.get(F.lit(pieces), cell) - 1

    own = F.pmod(F.xxhash64("item_id"), F.get(F.lit(pieces), F.col("cell")))
    items = store.select(
        (start(F.col("cell")) + own).cast("int").alias("slab"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "item_id", "vector", "cell")
    met = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.sequence(start(c), end(c)))))
    asked = queries.select(
        F.explode(met).alias("slab"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        "query_id", "vector", "cells",
    ).withColumn("cells", F.filter("cells", lambda c: F.col("slab").between(start(c), end(c))))
    return _placed(_met(items, asked, _best_in_cells(k)), k)


@dataclass(frozen=True)
class CellSearch:
    """Approximate search in trained cells.

    ``train_rows`` bounds the sample that the centres are trained on, ``calibration`` the
    sample of queries that are also searched exactly: the cells around a query are opened in
    order of their centres until ``recall`` of those exact hits would have been met. So the
    number of cells follows from the wanted recall on this store, whatever its size. Every
    item is indexed.
    """

    recall: float = 0.95
    train_rows: int = 16_384
    most_cells: int = 1_024
    rounds: int = 8
    calibration: int = 256

    def centres(self, store: DataFrame) -> np.ndarray:
        """Centres of unit length, about the root of the number of items, by k-means."""
        rows = _sample(store, "item_id", self.train_rows).select("vector").toPandas()["vector"]
        if not len(rows):
            return np.zeros((0, 0))
        sample, rng = _unit(rows), np.random.default_rng(1)
        count = int(min(self.most_cells, max(4, round(store.count() ** 0.5)), len(sample)))
        found = sample[rng.permutation(len(sample))[:count]]
        for _ in range(self.rounds):
            own = (sample @ found.T).argmax(1)
            sums = np.zeros_like(found)
            np.add.at(sums, own, sample)
            empty = np.bincount(own, minlength=count) == 0
            sums[empty] = found[empty]
            found = _unit(sums)
        return found

    def __call__(self, queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
        queries, store = (df.select(name, F.col("vector").cast("array<double>").alias("vector"))
                          for df, name in zip(comparable(queries, store), ("query_id", "item_id")))
        centres = self.centres(store)
        if not len(centres):
            return nearest(queries, store, k)

        dealt = _with_cells(store, centres, "cell int", lambda near: near.argmax(1).astype(np.int32))
        ordered = _with_cells(queries, centres, "cells array<int>", lambda near: list(
            np.argsort(-near, axis=1, kind="stable").astype(np.int32)))
        opened = self._opened(ordered, dealt, k, len(centres))
        return _in_cells(ordered.withColumn("cells", F.slice("cells", 1, opened)), dealt, k, len(centres))

    def _opened(self, ordered: DataFrame, dealt: DataFrame, k: int, cells: int) -> int:
        """How many cells hold the wanted share of the exact hits of some queries."""
        some = _sample(ordered, "query_id", self.calibration)
        hits = nearest(some.select("query_id", "vector"), dealt.select("item_id", "vector"), k)
        place = hits.join(dealt.select("item_id", "cell"), "item_id").join(
            some.select("query_id", "cells"), "query_id").select(F.array_position("cells", F.col("cell")).alias("place"))
        counts = dict(tuple(r) for r in place.groupBy("place").count().collect())  # at most one row per cell
        wanted, met = self.recall * sum(counts.values()), 0
        for opened in range(1, cells + 1):
            met += counts.get(opened, 0)
            if met >= wanted:
                return opened
        return cells


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found."""
    pair = ["query_id", "item_id"]
    hit = found.select(*pair).withColumn("hit", F.lit(1))
    return exact.select(*pair).join(hit, pair, "left").agg(
        F.count("*").alias("expected"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("found"),
    )


