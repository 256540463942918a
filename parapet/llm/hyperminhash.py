"""Near-duplicates by HyperMinHash.

A document is the set of its word shingles. The set's hashes fall into 128 buckets; a
bucket keeps its least hash as a leading-zero count and ten mantissa bits (16 bits). Bands
of four registers meet in candidate groups, the collision-corrected estimate drops what is
far below the threshold, and the full sets decide.

Equal sets are one node from the start. Of the rest, each member of a candidate group is
compared with the group's most central node, its hub. What is then left are pairs of
members, neither of them the hub, of different components:

- a hub whose groups hold at most ``PER_GROUP`` nodes together: these are compared inside one
  task, across components only, and only links leave it;
- other hubs: the same, group by group;
- a group of more nodes: its members meet again in narrower groups, which agree in 8, 12, 16
  and more registers drawn for each group anew, empty ones filled up. Small ones are compared
  as above, large ones get a hub of their own, and so on until no large group spans components.

Two nodes are compared in the first small group that both are in, so once per step.

So every step emits a fixed number of rows per node, none by the size of a group, and no
group of candidates is ever expanded into pairs.

Chance of missing a pair exactly at the threshold, by step: bands of four,
(1 - 0.85**4)**32 = 6e-11 at 0.85 and 5e-8 at 0.8; the estimate is cut six standard deviations
below the threshold. For pairs that share only large groups: ``keys_for`` draws so many groups
that the chance is e**-16 up to 16 registers at 0.8 (20 at 0.85), e**-5 at 24 and more beyond;
it takes a family of texts of which thousands lie just below the threshold to get there.

Nodes are 128-bit digests of sets: 1e11 sets collide with a chance of 1e-17.

Defined cases: a null, empty or white text has no set and stays alone, as does a null id;
with fewer words than a shingle the whole sequence is one shingle; repeated ids are judged
row by row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parapet.llm.blocks import LOWER, SPACED, Block, blocks, hashes, mix, shingles, words
from parapet.llm.connect import components
from parapet.llm.shared import attach, stage

BUCKET_BITS, MANTISSA_BITS, BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND
EMPTY = 0xFFFF
FLOORS = (np.arange(BUCKETS + 1, dtype=object) << (64 - BUCKET_BITS))[:-1].astype(np.uint64)
PER_HUB, PER_TILE = 64, 256
PER_GROUP, MOST_SHINGLES = 4096, 8_000_000  # of a group that one task compares: 1 MB and 64 MB
WIDTHS, MOST_KEYS = (8, 12, 16, 24, 32, 48, 64, 96, 128), 1024


@dataclass(frozen=True)
class Similarity:
    """Shingle length and the least Jaccard similarity in hundredths."""

    words: int = 5
    percent: int = 80

    def least_estimate(self) -> float:
        j = self.percent / 100
        return j - 6 * (j * (1 - j) / BUCKETS) ** 0.5


def shingle_sets(block: Block, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    data = LOWER[block.data]
    found = words(block, SPACED, data)
    values = hashes(data, found.start, found.end)
    keys, places = shingles(values, found.row, size)
    cuts = np.searchsorted(found.row[places], np.arange(len(block) + 1))
    firsts = np.searchsorted(found.row, np.arange(len(block) + 1))
    sets = []
    for i, count in enumerate(found.per_row):
        if 0 < count < size:
            own = values[firsts[i]:firsts[i + 1]]
            sets.append(shingles(own, np.zeros(count, np.int64), int(count))[0])
        else:
            sets.append(np.unique(keys[cuts[i]:cuts[i + 1]]))
    return sets


def registers(ordered: np.ndarray) -> np.ndarray:
    """Compressed registers of sorted hashes: the bucket is the top of the hash."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    first = np.searchsorted(ordered, FLOORS)
    filled = np.diff(np.append(first, len(ordered))) > 0
    least = (ordered[first[filled]] << np.uint64(BUCKET_BITS)).astype(np.float64)
    fraction, exponent = np.frexp(np.maximum(least, 1.0))
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint16)
    mantissa = np.minimum((fraction * 2 - 1) * (1 << MANTISSA_BITS), (1 << MANTISSA_BITS) - 1)
    out[filled] = (zeros << MANTISSA_BITS) | mantissa.astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of register rows, corrected for chance collisions."""
    filled = (a != EMPTY) | (b != EMPTY)
    union = np.maximum(filled.sum(-1), 1)
    equal = ((a == b) & filled).sum(-1)
    large, small = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    ratio = large / np.maximum(small, 1)
    chance = 0.169919487 * 2.0 ** (1 - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return equal / union - chance


def node_of(ordered: np.ndarray) -> bytes:
    return hashlib.blake2b(ordered.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node, registers``; node and registers are null for
    an empty set. Rows with equal sets have the same node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = shingle_sets(block, size)
            yield pa.RecordBatch.from_arrays([
                block.rows.column(0), block.rows.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "text_hash", "n_shingles", "node", "registers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, n_shingles long, node binary, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def band_rows(nodes: DataFrame) -> DataFrame:
    """``band, node``: one row per filled band; the band's number is part of its hash."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _matrix(batch.column(1)).reshape(-1, BANDS, BAND)
            packed = np.ascontiguousarray(regs).view(np.uint64)[:, :, 0]
            filled = packed != np.uint64(0xFFFFFFFFFFFFFFFF)
            keys = packed * np.uint64(0x9E3779B97F4A7C15)
            keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys = (keys ^ (keys >> np.uint64(32))) & np.uint64(0x07FFFFFFFFFFFFFF)
            keys |= np.arange(BANDS, dtype=np.uint64)[None, :] << np.uint64(59)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[filled].view(np.int64)), batch.column(0).take(pa.array(np.nonzero(filled)[0]))],
                ["band", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "band long, node binary")


def keys_for(width: int, like: Similarity) -> int:
    """How many groups of ``width`` registers a node joins: a pair at the threshold then
    shares 16 of them on average, fewer beyond ``MOST_KEYS``."""
    return 1 if width == BUCKETS else min(MOST_KEYS, int(np.ceil(16 / (like.percent / 100) ** width)))


_DRAW = np.random.default_rng(BUCKETS)
#: For each bucket the order in which it borrows from others while it is empty.
BORROW = np.stack([np.concatenate([[i], _DRAW.permutation(np.delete(np.arange(BUCKETS), i))]) for i in range(BUCKETS)])


def filled_up(regs: np.ndarray) -> np.ndarray:
    """Registers without gaps: an empty bucket has the register of the first filled one in
    its own order of buckets. So every register of two sets agrees with a chance near their
    similarity, also in sets that are smaller than the number of buckets."""
    held = regs != EMPTY
    lender = BORROW[np.arange(BUCKETS), held[:, BORROW].argmax(-1)]
    return np.take_along_axis(regs, lender, 1)


def drawn_sets(width: int, like: Similarity) -> np.ndarray:
    """The registers of every group of ``width``: (groups, width)."""
    rng = np.random.default_rng(width)
    return np.stack([rng.permutation(BUCKETS)[:width] for _ in range(keys_for(width, like))])


def register_rows(nodes: DataFrame, width: int, like: Similarity) -> DataFrame:
    """``key, number, node``: one row per drawn set of registers."""
    drawn = drawn_sets(width, like)
    numbers = np.arange(len(drawn), dtype=np.int32)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = filled_up(_matrix(batch.column(1))).astype(np.uint64)
            keys = np.repeat(mix((numbers + 1).astype(np.uint64) * np.uint64(width))[None, :], len(regs), 0)
            for place in drawn.T:
                keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + regs[:, place])
            row = np.repeat(np.arange(len(regs)), len(drawn))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(numbers, len(regs))),
                 batch.column(0).take(pa.array(row))], ["key", "number", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "key long, number int, node binary")


def _met_before(a: np.ndarray, b: np.ndarray, number: int, width: int, like: Similarity) -> np.ndarray:
    """Whether registers ``a`` agree with each row of ``b`` in a group before ``number``."""
    if number <= 0:
        return np.zeros(len(b), bool)
    if width == BAND:
        same = (b == a).reshape(-1, BANDS, BAND).all(-1) & (a != EMPTY).reshape(BANDS, BAND).any(-1)
        return same[:, :number].any(-1)
    same = filled_up(b) == filled_up(a[None])
    return same[:, drawn_sets(width, like)[:number]].all(-1).any(-1)


def _with_registers(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("u", "v"):
        pairs = pairs.join(nodes.select(
            F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"),
            F.col("registers").alias(f"regs_{end}")), end)
    return pairs


def likely(pairs: DataFrame, nodes: DataFrame, like: Similarity) -> DataFrame:
    """The pairs ``u, v`` whose sizes and registers allow the threshold."""
    percent, least = like.percent, like.least_estimate()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n_u, n_v = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            good = estimate(_matrix(batch.column(4)), _matrix(batch.column(5)), n_u, n_v) >= least
            yield batch.select([0, 1]).filter(pa.array(good))

    wide = _with_registers(pairs, nodes).select("u", "v", "n_u", "n_v", "regs_u", "regs_v")
    wide = wide.filter(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
    return wide.mapInArrow(run, "u binary, v binary")


def single_texts(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """``first_id, first_hash, text``: every id and text once. Only where rows are repeated
    they are combined, before the shuffle of the joins with this table."""
    texts = docs.select(F.col("doc_id").alias("first_id"), F.xxhash64("text").alias("first_hash"), "text")
    if signed.groupBy("doc_id", "text_hash").count().filter("count > 1 AND doc_id IS NOT NULL").isEmpty():
        return texts
    return texts.groupBy("first_id", "first_hash").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, like: Similarity) -> DataFrame:
    """The pairs whose full sets reach the threshold.

    A text travels to each group of ``PER_HUB`` pairs of one ``u``; within a group the text
    of u comes first and is the only set held.
    """
    hubs = stage(pairs.groupBy("u").agg(F.count("*").alias("members"),
                                        F.ceil(F.count("*") / PER_HUB).alias("parts")), "hub-sizes")
    dealt = attach(pairs, hubs, "u", "members").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    routes = stage(dealt.select("u", "part", F.col("v").alias("node"), F.lit(1).alias("turn"))
                   .unionByName(dealt.select("u", "part", F.col("u").alias("node"),
                                             F.lit(0).alias("turn")).distinct()), "routes")
    ids = routes.join(nodes.select("node", "first_id", "first_hash"), "node")
    rows = ids.join(texts, ["first_id", "first_hash"]).select("u", "part", "turn", "node", "text")
    size, percent = like.words, like.percent

    def run(batches):
        hub, hub_set = None, None
        for block in blocks(batches):
            sets = shingle_sets(block, size)
            u, v = [], []
            for key, part, turn, node, own in zip(
                    *(block.rows.column(i).to_pylist() for i in range(4)), sets):
                if turn == 0:
                    hub, hub_set = (key, part), own
                elif hub == (key, part):
                    # Python integers: an intersection never overflows
                    same = len(np.intersect1d(hub_set, own, assume_unique=True))
                    if 100 * same >= percent * (len(hub_set) + len(own) - same):
                        u.append(key)
                        v.append(node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "u", "part").sortWithinPartitions("u", "part", "turn")
            .mapInArrow(run, "u binary, v binary").distinct())


def _rivals(label: np.ndarray, size: np.ndarray, regs: np.ndarray, like: Similarity
            ) -> Iterator[tuple[int, np.ndarray]]:
    """For each place the later places of other components that may reach the threshold."""
    least = like.least_estimate()
    for a in range(len(label) - 1):
        b = np.arange(a + 1, len(label))
        b = b[(label[b] != label[a])
              & (np.minimum(size[b], size[a]) * 100 >= np.maximum(size[b], size[a]) * like.percent)]
        if len(b):
            b = b[estimate(regs[b], regs[a], size[b], size[a]) >= least]
        if len(b):
            yield a, b


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two blocks of sets: products of slices of the
    membership matrices over the values that both blocks hold."""
    out, step = np.zeros((len(left), len(right)), np.int64), 4096
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    sides = []
    for sets in (left, right):
        values = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(m) for m in sets])
        place = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        held = both[place] == values if len(both) else np.zeros(len(values), bool)
        row, place = row[held], place[held]
        order = np.argsort(place, kind="stable")
        sides.append((len(sets), row[order], place[order]))
    for first in range(0, len(both), step):
        members = []
        for count, row, place in sides:
            own = slice(*np.searchsorted(place, [first, first + step]))
            member = np.zeros((count, min(step, len(both) - first)), np.float32)
            member[row[own], place[own] - first] = 1
            members.append(member)
        out += np.rint(members[0] @ members[1].T).astype(np.int64)
    return out


def _numbers(values: list) -> np.ndarray:
    """Equal values by equal numbers."""
    seen: dict = {}
    return np.array([seen.setdefault(v, len(seen)) for v in values], np.int64)


def _groups_of(batches) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches by their first column, one group at a time."""
    key, group = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
            if row[0] != key:
                if group:
                    yield key, group
                key, group = row[0], []
            group.append(row[1:])
    if group:
        yield key, group


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "node")


def doubtful(members: DataFrame, nodes: DataFrame, like: Similarity, width: int) -> DataFrame:
    """``key, label, node``: the members of each group that have a likely partner in another
    component, if this is the first group that both are in."""
    rows = members.select("key", "number", "label", "node").join(
        nodes.select("node", "n_shingles", "registers"), "node").select(
        "key", "number", "label", "node", "n_shingles", "registers")

    def run(batches):
        for key, group in _groups_of(batches):
            label, size = _numbers([row[1] for row in group]), np.array([row[3] for row in group])
            regs = np.frombuffer(b"".join(row[4] for row in group), np.uint16).reshape(-1, BUCKETS)
            found = np.zeros(len(group), bool)
            for a, b in _rivals(label, size, regs, like):
                b = b[~_met_before(regs[a], regs[b], group[0][0], width, like)]
                found[a] |= len(b) > 0
                found[b] = True
            kept = [row for row, good in zip(group, found) if good]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(kept), pa.int64()), pa.array([row[1] for row in kept], pa.binary()),
                 pa.array([row[2] for row in kept], pa.binary())], ["key", "label", "node"])

    return _dealt(rows).mapInArrow(run, "key long, label binary, node binary")


def linked_across(rows: DataFrame, nodes: DataFrame, texts: DataFrame, like: Similarity) -> DataFrame:
    """Links ``u, v`` between components, decided on the full sets inside each group;
    members that a link has joined are not linked again."""
    named = rows.join(nodes.select("node", "first_id", "first_hash"), "node")
    wide = named.join(texts, ["first_id", "first_hash"]).select("key", "label", "node", "text")

    def run(batches):
        key, group = None, []
        for block in blocks(batches):
            sets = shingle_sets(block, like.words)
            for own, label, node, members in zip(*(block.rows.column(c).to_pylist() for c in range(3)), sets):
                if own != key:
                    yield compared(group)
                    key, group = own, []
                group.append((label, node, members))
        yield compared(group)

    def compared(group) -> pa.RecordBatch:
        u, v = [], []
        label, sets = _numbers([row[0] for row in group or ()]), [row[2] for row in group or ()]
        size = np.array([len(m) for m in sets])
        for first in range(0, len(sets), PER_TILE):
            for second in range(first, len(sets), PER_TILE):
                p, q = slice(first, first + PER_TILE), slice(second, second + PER_TILE)
                if (label[p][:, None] == label[q]).all():
                    continue
                same = shared_sizes(sets[p], sets[q])
                near = 100 * same >= like.percent * (size[p][:, None] + size[q] - same)
                for a, b in np.argwhere(near) + (first, second):
                    if label[a] != label[b]:
                        u.append(group[a][1])
                        v.append(group[b][1])
                        label[label == label[b]] = label[a]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return _dealt(wide).mapInArrow(run, "u binary, v binary").distinct()


def _spanning(rows: DataFrame) -> DataFrame:
    """``key, members, small`` of the groups that span components."""
    groups = rows.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"),
        F.sum("n_shingles").alias("weight"))
    small = (F.col("members") <= PER_GROUP) & (F.col("weight") <= MOST_SHINGLES)
    return stage(groups.filter("low < high").select("key", "members", small.alias("small")), "spanning")


def _starred(rows: DataFrame) -> DataFrame:
    """``u, v``: in each group a hub and its members of other components. The hub is the
    member with the largest hash, so groups of the same texts have few hubs."""
    rank = F.struct(F.xxhash64("node"), "node", "label")
    hubs = stage(rows.groupBy("key").agg(F.max(rank).alias("hub"), F.count("*").alias("members")).select(
        "key", F.col("hub.node").alias("u"), F.col("hub.label").alias("hub_label"), "members"), "group-hubs")
    return attach(rows, hubs, "key", "members").filter("label <> hub_label").select("u", F.col("node").alias("v")).distinct()


class _Links:
    """The components that the links found so far make."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, like: Similarity, linked: DataFrame) -> None:
        self.nodes, self.texts, self.like = nodes, texts, like
        labels = components(linked)
        self.named = stage(nodes.join(labels, "node", "left").select(
            "node", "first_id", "copies", "n_shingles", F.coalesce("label", "node").alias("label")), "named")

    def _add(self, links: DataFrame) -> None:
        """Join the components at both ends of new links."""
        if links.isEmpty():
            return
        for end in ("u", "v"):
            links = links.join(self.named.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")), end)
        moved = components(links.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
        moved = moved.select(F.col("node").alias("label"), F.col("label").alias("_label"))
        self.named = stage(self.named.join(moved, "label", "left").select(
            "node", "first_id", "copies", "n_shingles", F.coalesce("_label", "label").alias("label")), "named")

    def labelled(self, rows: DataFrame) -> DataFrame:
        """``key, number, node, label, n_shingles`` of rows with ``key, number, node``."""
        return stage(rows.join(self.named.select("node", "label", "n_shingles"), "node").select(
            "key", "number", "node", "label", "n_shingles"), "labelled")

    def meet(self, rows: DataFrame, width: int) -> DataFrame:
        """Compare across components within the small groups of ``key, number, node``, and with
        a hub within the large ones; returns the nodes of large groups that still span some."""
        marked = self.labelled(rows)
        groups = _spanning(marked)
        sizes = {r["small"] for r in groups.select("small").distinct().collect()}
        nobody = rows.select("node").limit(0)
        if not sizes:
            return nobody
        marked = stage(attach(marked, groups, "key", "members").filter("small IS NOT NULL"), "marked")
        links = []
        if True in sizes:
            left = stage(doubtful(marked.filter("small"), self.nodes, self.like, width), "doubtful")
            links.append(linked_across(left, self.nodes, self.texts, self.like))
        large = marked.filter("NOT small").select("key", "number", "node", "label", "n_shingles")
        if False in sizes:
            pairs = stage(likely(_starred(large), self.nodes, self.like), "likely")
            links.append(verified(pairs, self.nodes, self.texts, self.like))
        self._add(stage(links[0].unionByName(links[-1]) if len(links) > 1 else links[0], "linked"))
        if False not in sizes:
            return nobody
        again = self.labelled(large.select("key", "number", "node"))
        return stage(attach(again, _spanning(again), "key", "members").filter("small IS NOT NULL").select(
            "node").distinct(), "left-over")


def near_groups(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` for every row.

    ``component_id`` is the least id reachable over links; it is the own id (and the row is
    kept) for an empty set or a null id.
    """
    signed = stage(signatures(docs, like.words), "signed")
    nodes = stage(
        signed.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"),
            F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        .select("node", F.col("first.doc_id").alias("first_id"),
                F.col("first.text_hash").alias("first_hash"), "copies", "n_shingles", "registers"),
        "nodes")
    texts = single_texts(docs, signed)
    bands = stage(band_rows(nodes), "bands")
    groups = stage(bands.groupBy("band").agg(F.lit(True).alias("shared"), F.count("*").alias("members"))
                   .filter("members > 1"), "groups")
    met = stage(attach(bands, groups, "band", "members").filter("shared").select("band", "node"), "met")
    # the most central member of a group is the one that shares the most bands with others
    sizes = groups.select("band", "members", F.col("members").alias("weight"))
    central = attach(met, sizes, "band", "members").groupBy("node").agg(F.sum("weight").alias("degree"))
    ranked = met.join(stage(central, "central"), "node")
    hubs = stage(ranked.groupBy("band").agg(
        F.max(F.struct("degree", "node"))["node"].alias("hub"), F.count("*").alias("members")), "hubs")
    dealt = stage(attach(met, hubs, "band", "members"), "dealt")
    stars = stage(dealt.select("hub", "node").distinct(), "stars")
    pairs = stars.filter("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    first = stage(verified(stage(likely(pairs, nodes, like), "likely"), nodes, texts, like), "linked")
    links = _Links(nodes, texts, like, first)
    # the groups of a small star are compared together, those of a large one each on its own
    star = F.xxhash64("hub")
    busy = stage(stars.groupBy(star.alias("star")).agg(F.count("*").alias("members")).filter(
        F.col("members") > PER_GROUP).select("star"), "busy-stars")
    small = stars.select("node", star.alias("star")).join(busy, "star", "left_anti")
    large = dealt.filter("node <> hub").select("band", "node", star.alias("star")).join(busy, "star", "left_semi")
    left = links.meet(small.select(F.col("star").alias("key"), F.lit(-1).alias("number"), "node").unionByName(
        large.select(
            F.col("band").alias("key"), F.shiftrightunsigned("band", 59).cast("int").alias("number"), "node")), BAND)
    for width in WIDTHS:
        if left.isEmpty():
            break
        left = links.meet(register_rows(nodes.join(left, "node", "left_semi"), width, like), width)
    named = links.named
    least = stage(named.groupBy("label").agg(F.min("first_id").alias("component"),
                                             F.count("*").alias("members")), "least")
    named = stage(attach(named, least, "label", "members").select("node", "copies", "component"),
                  "components")
    rows = signed.select("doc_id", "text_hash", "n_shingles",
                         F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return attach(rows, named, "node", "copies").select(
        "doc_id", "text_hash", "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """One document of each group, all columns as they are; a row that is repeated with its
    id and text stays once, rows without an id all stay."""
    kept = stage(near_groups(docs, like).filter("kept AND doc_id IS NOT NULL").select(
        "doc_id", "text_hash").distinct(), "kept")
    mark = "__near_copy_hash"
    texts = docs.withColumn(mark, F.xxhash64("text"))
    named = texts.filter("doc_id IS NOT NULL")
    once = named.join(kept.withColumnRenamed("text_hash", mark), ["doc_id", mark], "left_semi")
    return (once.dropDuplicates(["doc_id", mark])
            .unionByName(texts.filter("doc_id IS NULL")).select(*docs.columns))
