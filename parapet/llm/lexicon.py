"""BPE encoding and decoding with a word lexicon in a minimal acyclic transducer.

A word is a run without white space; the tokenizer cuts it into pieces. The most frequent
pieces of the corpus are encoded once and compiled into a minimal acyclic automaton with shared suffixes. Each arc carries
a number; the numbers along a piece add up to its place among all pieces, and that place
addresses its ids. The arrays are mapped into memory by the workers and walked for many
pieces at once. Pieces outside the lexicon are merged by the tokenizer's own ranks, so
every text gets exactly the ids of the tokenizer whether its words are frequent or not.

The tokenizer file describes a BPE with word-end suffix over byte letters, lower-cased
and normalised to NFC, with special tokens found in the raw text; its path is a parameter.

Defined cases: a null text is an empty one; empty and white texts have no ids and decode
to the empty text; the ids of a lone long word are merged with a heap in n log n steps;
repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from parapet.llm.blocks import blocks
from parapet.llm.shared import arrive, most_frequent, ship, stage

LEXICON_WORDS = 1 << 17
LONGEST_ENTRY = 64
MEMO_WORDS = 1 << 19
COUNTED_WORDS = 1 << 18
SHORT = 48
NO_RANK = 1 << 60
WHITE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters that Python splits at and the tokenizer does not.
ODD_WHITE = regex.compile("[\x1c-\x1f]")


def split_words(text: str) -> list[str]:
    return [w for w in WHITE.split(text) if w] if ODD_WHITE.search(text) else text.split()


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the others follow
    from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    later = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(later)) for b in range(256)]


class WordBpe:
    """The tokenizer's rules for one word, read from its file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for name, number in [*self.vocab.items(), *self.special.items()]:
            self.names[number] = name
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in letters]
        self.final = [self.vocab.get(c + self.suffix) for c in letters]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.specials = regex.compile("|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))

    @classmethod
    def from_file(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the pair of least rank merges first, the leftmost of equals."""
        raw = piece.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(p, NO_RANK) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            i = ranks.index(least)
            ids[i:i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank_of, n = self.ranks.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank_of(p), i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = self.made[rank], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((i, after[i]), (before[i], i)):
                if left >= 0 and right < n:
                    new = rank_of((ids[left], ids[right]))
                    if new is not None:
                        heapq.heappush(heap, (new, left))
        return [i for i in ids if i is not None]

    def split(self, word: str) -> list[str]:
        """The pieces of a word without special tokens: lower case, NFC."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
            if "\u03a3" in word:  # a final sigma is lowered like any other
                word = "".join([c.lower() for c in word])
        word = word.lower()
        return [word] if word.isalpha() else self.pieces.findall(word)

    def words_of(self, text: str) -> list[str]:
        """Words of a text in order; a special token is a word of its own."""
        if not any(t in text for t in self.special):
            return split_words(text)
        out, at = [], 0
        for match in self.specials.finditer(text):
            out += [*split_words(text[at:match.start()]), match.group()]
            at = match.end()
        return out + split_words(text[at:])

    def decode(self, ids: Iterable[int]) -> str:
        """The tokenizer has no decoder of its own, so tokens are joined by blanks."""
        return " ".join([self.names[i] for i in ids])


def compile_lexicon(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of the words, built from sorted words.

    Arcs are sorted by state and byte. ``adds`` of an arc is the number of words that come
    before those below it, ``ends`` marks states that close a word.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list]] = []

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path, last = [[False, []]], b""
    ordered = sorted(w for w in entries if w)
    for word in ordered:
        shared = len(os.path.commonprefix([word, last]))
        while len(path) - 1 > shared:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    below = np.zeros(len(states), np.int64)
    keys, targets, adds = [], [], []
    for state, (closes, arcs) in enumerate(states):  # children come before their parents
        total = int(closes)
        for byte, target in arcs:
            keys.append(state * 256 + byte)
            targets.append(target)
            adds.append(total)
            total += below[target]
        below[state] = total
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    ids = [entries[w] for w in ordered]
    return {
        "keys": np.array(keys, np.int64)[order], "targets": np.array(targets, np.int32)[order],
        "adds": np.array(adds, np.int32)[order],
        "ends": np.array([closes for closes, _ in states], np.uint8),
        "stops": np.cumsum([0, *map(len, ids)]).astype(np.int64),
        "ids": np.array([i for own in ids for i in own], np.uint32),
        "root": np.array([root], np.int64),
    }


def look_up(lexicon: dict[str, np.ndarray], entries: list[bytes]) -> np.ndarray:
    """Place of each word in the lexicon, -1 for others; one step of all words at a time."""
    place = np.full(len(entries), -1, np.int64)
    if not len(lexicon["keys"]) or not entries:
        return place
    length = np.array([len(w) for w in entries])
    data = np.frombuffer(b"".join(entries), np.uint8)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    live = np.arange(len(entries))
    state = np.full(len(entries), lexicon["root"][0], np.int64)
    total = np.zeros(len(entries), np.int64)
    step = 0
    while len(live):
        done = length[live] == step
        closing = live[done]
        good = closing[lexicon["ends"][state[closing]] == 1]
        place[good] = total[good]
        live = live[~done]
        key = state[live] * 256 + data[start[live] + step]
        arc = np.minimum(np.searchsorted(lexicon["keys"], key), len(lexicon["keys"]) - 1)
        real = lexicon["keys"][arc] == key
        live, arc = live[real], arc[real]
        total[live] += lexicon["adds"][arc]
        state[live] = lexicon["targets"][arc]
        step += 1
    return place


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts, counted in the tasks before the shuffle."""
    def run(batches):
        counts: Counter = Counter()
        for block in blocks(batches):
            for text in block.rows.column(0).to_pylist():
                counts.update(split_words(text or ""))
            if len(counts) >= COUNTED_WORDS:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, tokenizer: str) -> DataFrame:
    """The counts of the tokenizer's pieces from the counts of words."""
    counts.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches):
        bpe = WordBpe.from_file(SparkFiles.get(name))
        for batch in batches:
            own: Counter = Counter()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in bpe.split(word):
                    own[piece] += n
            yield _counted(own)

    return counts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def ship_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> tuple[str, str]:
    """Compile the most frequent pieces, at most ``size``, of at most ``LONGEST_ENTRY`` bytes, so the
    lexicon is bounded. Returns the names of the shipped lexicon and tokenizer file."""
    bpe = WordBpe.from_file(tokenizer)
    pieces = stage(piece_counts(word_counts(docs), tokenizer).filter(
        F.octet_length("word") <= LONGEST_ENTRY), "pieces")
    chosen = most_frequent(pieces, "n", size).select("word").toArrow().column(0).to_pylist()
    entries = {word.encode(): bpe.merge(word) for word in chosen}
    return ship(docs.sparkSession, "lexicon", compile_lexicon(entries)), os.path.basename(tokenizer)


class Encoder:
    """Encodes texts in a task: memo of words, memo of pieces, lexicon, merges."""

    def __init__(self, lexicon: dict[str, np.ndarray], bpe: WordBpe):
        self.lexicon, self.bpe = lexicon, bpe
        self.names = np.array(bpe.names, object)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, list[int]] = {w: [i] for w, i in self.bpe.special.items()}
        self.pieces: dict[str, list[int]] = {}

    def learn(self, fresh: list[str]) -> None:
        parts = [self.bpe.split(w) for w in fresh]
        new = list({p for own in parts for p in own}.difference(self.pieces))
        stops, ids = self.lexicon["stops"], self.lexicon["ids"]
        for piece, p in zip(new, look_up(self.lexicon, [w.encode() for w in new]).tolist()):
            self.pieces[piece] = (ids[stops[p]:stops[p + 1]].tolist() if p >= 0
                                  else self.bpe.merge(piece))
        known, words = self.pieces, self.words
        for word, own in zip(fresh, parts):
            words[word] = known[own[0]] if len(own) == 1 else [i for p in own for i in known[p]]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > MEMO_WORDS:
            self.forget()
        parts = [self.bpe.words_of(t) if t else [] for t in texts]
        fresh = set().union(*parts).difference(self.words)
        if fresh:
            self.learn(list(fresh))
        known = self.words.__getitem__
        return [np.array(list(chain.from_iterable(map(known, p))), np.uint32) for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.names[ids].tolist())


def encoded(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS,
            with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` for every document; without
    ``with_ids`` the digests alone."""
    names = ship_lexicon(docs, tokenizer, size)

    def run(batches):
        encoder = Encoder(arrive(names[0])[0], WordBpe.from_file(SparkFiles.get(names[1])))
        for block in blocks(batches):
            ids = encoder.encode(block.rows.column(1).to_pylist())
            columns = [
                block.rows.column(0), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(i).encode()).hexdigest() for i in ids], pa.string())]
            fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                fields.append("ids")
            yield pa.RecordBatch.from_arrays(columns, fields)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)
