"""Quality scores from random-indexing word vectors and a two-layer network.

Every word form, and every word's shape, has a sparse random index vector drawn from its
hash. The vector of a form (in one of ``SLOTS`` hashed places) and of a shape is the sum of
the index vectors of the words up to two places away, over all texts. A document is the
mean and the spread of the unit vectors of its words, with its length and its share of
distinct words; a network with one hidden layer, in numpy, gives a logit, and a
temperature fitted on rows that it did not learn from turns it into a probability.

Word vectors are learned from the texts of all documents, without labels. The network is
fitted on at most ``SAMPLE_ROWS`` labelled rows outside the held-out fold, chosen by hash;
label tables of any size are reduced to these rows before anything is collected.

Defined cases: a null or empty text has no words and gets the score of the zero vector;
several labels of one id: the largest counts; without labelled rows of both kinds the score
is the share of good labels (a half without any); repeated rows get equal scores; other
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parapet.llm.blocks import Block, blocks, hashes, mix, weighted_rows, word_bytes
from parapet.llm.shared import arrive, ship

SLOT_BITS, DIMENSIONS, REACH, NONZERO = 15, 64, 2, 2
SLOTS = 1 << SLOT_BITS
SHAPES = 256
CHUNKS, LANES = 64, 4
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, RATE = 32, 40, 0.003
FOLDS, FOLD = 5, 0
THRESHOLD = 0.3
FEATURES = 4 * DIMENSIONS + 3

WHITE = ~word_bytes([0x20, *range(0x09, 0x0E)])
LETTERS = ~word_bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Bits of a byte's class.
SIGN, LOW, UPPER, DIGIT, OTHER = 1, 2, 4, 8, 16
CLASS = np.full(256, SIGN, np.uint8)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A], CLASS[0x80:] = LOW, UPPER, DIGIT, OTHER
GROUP = np.where(WHITE, 0, np.where(LETTERS, 1, 2)).astype(np.uint8)


def with_fold(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.withColumn("held_out", fold == FOLD)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form hash, shape and row of every word: runs of letters and digits, runs of signs."""
    data = block.data
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = GROUP[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = group[1:] != group[:-1]
    begins = block.offsets[:-1]
    fresh[begins[begins < len(data)]] = True
    start = np.flatnonzero(fresh)
    holds = np.bitwise_or.reduceat(CLASS[data], start)
    end = np.append(start[1:], len(data))
    word = group[start] > 0
    start, end, holds = start[word], end[word], holds[word]
    cased = np.where(holds == UPPER, 3, np.where(CLASS[data[start]] == UPPER, 2, (holds & UPPER) > 0))
    shape = (np.minimum(end - start, 15) * 16 + ((holds & SIGN) > 0) * 8 + ((holds & DIGIT) > 0) * 4 + cased)
    return hashes(data, start, end), shape.astype(np.int64), block.row_of(start)


def _index(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and signs of the random index vectors of hashed words."""
    out, state = [], mix(values + np.uint64(0x51ED270B))
    for _ in range(NONZERO):
        out.append(((state >> np.uint64(8)) % np.uint64(DIMENSIONS), (state & np.uint64(1)) * np.uint64(2)))
        state = mix(state + np.uint64(1))
    return [(p.astype(np.int64), s.astype(np.int32) - np.int32(1)) for p, s in out]


def _slots(form: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (form >> np.uint64(64 - SLOT_BITS)).astype(np.int64), SLOTS + shape


def accumulate(block: Block, sums: np.ndarray) -> None:
    """Add the index vectors of neighbours to the vectors of the block's words."""
    form, shape, row = tokens(block)
    shape_hash = mix(shape.astype(np.uint64) + np.uint64(0xABCDEF))
    indexes = _index(form) + _index(shape_hash)
    flat = sums.reshape(-1)
    for target in _slots(form, shape):
        base = target * DIMENSIONS
        for away in range(1, REACH + 1):
            if len(form) <= away:
                continue
            near = row[away:] == row[:-away]
            for places, signs in indexes:
                for at, of in ((slice(None, -away), slice(away, None)), (slice(away, None), slice(None, -away))):
                    np.add.at(flat, base[at][near] + places[of][near], signs[of][near])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all slots and shapes. The sums of a task are cut into ``CHUNKS``
    pieces of fixed size, which Spark tasks add up in ``LANES`` lanes and then over the
    lanes, so the driver gets one table."""
    rows = SLOTS + SHAPES

    def run(batches):
        sums = np.zeros((rows, DIMENSIONS), np.int32)
        for block in blocks(batches):
            accumulate(block, sums)
        lane = TaskContext.get().partitionId() % LANES
        parts = np.array_split(sums.astype(np.int64).reshape(-1), CHUNKS)
        yield _chunks({(chunk, lane): part for chunk, part in enumerate(parts)})

    def add(whole: bool):
        def run_add(batches):
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for chunk, lane, packed in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    key, part = (chunk, 0 if whole else lane), _unpacked(packed)
                    held[key] = held[key] + part if key in held else part
            yield _chunks(held)
        return run_add

    schema = "chunk int, lane int, sums binary"
    parts = docs.select("text").mapInArrow(run, schema)
    lanes = parts.repartition(CHUNKS * LANES, "chunk", "lane").mapInArrow(add(False), schema)
    added = lanes.repartition(CHUNKS, "chunk").mapInArrow(add(True), schema).select("chunk", "sums").collect()
    pieces = {r[0]: _unpacked(r[1]) for r in added}
    if not pieces:
        return np.zeros((rows, DIMENSIONS), np.float32)
    table = np.concatenate([pieces[i] for i in range(CHUNKS)]).reshape(rows, DIMENSIONS).astype(np.float64)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length == 0, 1, length)).astype(np.float32)


def _chunks(parts: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in parts], pa.int32()), pa.array([k[1] for k in parts], pa.int32()),
         pa.array([_packed(p) for p in parts.values()], pa.binary())], ["chunk", "lane", "sums"])


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype(np.int64).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


def pooled(block: Block, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of forms and shapes, and three sizes, per row."""
    form, shape, row = tokens(block)
    out = np.zeros((len(block), FEATURES), np.float32)
    if not len(form):
        return out
    words = np.bincount(row, minlength=len(block))
    filled = np.flatnonzero(words)
    count = words[filled, None].astype(np.float32)
    at = 0
    for slots in _slots(form, shape):
        used = np.flatnonzero(np.bincount(slots))
        table = np.zeros(used[-1] + 1, np.int64)
        table[used] = np.arange(len(used))
        both = np.concatenate([vectors[used], vectors[used] ** 2], axis=1)
        sums = weighted_rows(table[slots], row, len(block), both)[filled] / count
        mean, square = sums[:, :DIMENSIONS], sums[:, DIMENSIONS:]
        out[filled, at:at + DIMENSIONS] = mean
        out[filled, at + DIMENSIONS:at + 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
        at += 2 * DIMENSIONS
    kinds = np.unique(mix(form + mix(row.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(row[kinds], minlength=len(block))[filled]
    out[filled, at] = np.log1p(count[:, 0])
    out[filled, at + 1] = distinct / count[:, 0]
    out[filled, at + 2] = np.log1p(distinct) / np.log1p(count[:, 0])
    return out


class Network:
    """Two layers in numpy: tanh hidden units and one logit."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        hidden = np.tanh((x - w["center"]) / w["scale"] @ w["w1"] + w["b1"])
        return (hidden @ w["w2"] + w["b2"])[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.w["temperature"][0], -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        """Adam on log loss; every fifth row sets the temperature only."""
        rng = np.random.default_rng(seed)
        x, y = x.astype(np.float64), y.astype(np.float64)
        w = {"center": x.mean(0) if len(x) else np.zeros(FEATURES),
             "scale": x.std(0) + 1e-3 if len(x) else np.ones(FEATURES),
             "w1": rng.normal(0, 1 / FEATURES ** 0.5, (FEATURES, HIDDEN)), "b1": np.zeros(HIDDEN),
             "w2": rng.normal(0, 1 / HIDDEN ** 0.5, (HIDDEN, 1)), "b2": np.zeros(1),
             "temperature": np.ones(1)}
        net = cls(w)
        if len(np.unique(y)) < 2:
            w["w2"][:] = 0
            w["b2"][:] = 0 if not len(y) else (30 if y[0] else -30)
            return net
        turn = rng.permutation(len(x))
        late, early = turn[::5], np.setdiff1d(turn, turn[::5])
        z = (x - w["center"]) / w["scale"]
        moments = {k: (np.zeros_like(w[k]), np.zeros_like(w[k])) for k in ("w1", "b1", "w2", "b2")}
        step = 0
        for epoch in range(EPOCHS):
            rng.shuffle(early)
            for i in range(0, len(early), 128):
                own = early[i:i + 128]
                hidden = np.tanh(z[own] @ w["w1"] + w["b1"])
                p = 1 / (1 + np.exp(-np.clip(hidden @ w["w2"] + w["b2"], -30, 30)))
                d = (p - y[own, None]) / len(own)
                back = d @ w["w2"].T * (1 - hidden * hidden)
                grads = {"w2": hidden.T @ d + 1e-4 * w["w2"], "b2": d.sum(0),
                         "w1": z[own].T @ back + 1e-4 * w["w1"], "b1": back.sum(0)}
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    w[k] -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        logits = net.logits(x[late])
        loss = lambda t: np.mean(np.logaddexp(0, -(2 * y[late] - 1) * logits / t))
        w["temperature"][0] = min(np.geomspace(0.25, 16, 61), key=loss)
        return net


def training_rows(docs: DataFrame, labels: DataFrame, vectors: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, collected. Documents of
    equal id and text count once, and the bound is a hash below which they are taken, so
    an id that repeats neither reaches the driver whole nor pushes others out by its order."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    known = with_fold(known).filter("NOT held_out").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` rows of two numbers
    found = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id", "quality")), "doc_id")
    found = found.withColumn("at", F.xxhash64("doc_id", "text"))
    last = found.select("at").distinct().orderBy("at").limit(rows).agg(F.max("at")).first()[0]
    chosen = found.filter(F.col("at") <= F.lit(last)).dropDuplicates(["doc_id", "text"])

    def run(batches):
        table = arrive(vectors)[0]["vectors"]
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), block.rows.column(1),
                 pa.array([f.tobytes() for f in pooled(block, table)], pa.binary())],
                ["doc_id", "quality", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = chosen.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(
        run, f"doc_id {kind}, quality int, features binary").toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("features", "ascending")])
    x = np.frombuffer(b"".join(sample["features"].to_pylist()), np.float32).reshape(-1, FEATURES)
    return x, np.array(sample["quality"].to_pylist(), np.float64)


def rated(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    spark = docs.sparkSession
    vectors = ship(spark, "vectors", {"vectors": word_vectors(docs)})
    net = Network.fit(*training_rows(docs, labels, vectors, rows))
    name = ship(spark, "network", net.w)

    def run(batches):
        table, network = arrive(vectors)[0]["vectors"], Network(arrive(name)[0])
        for block in blocks(batches):
            score = network.scores(pooled(block, table).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(0), block.rows.column(1), pa.array(score),
                 pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_fold(docs.select("doc_id", "text")).select("doc_id", "held_out", "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")
