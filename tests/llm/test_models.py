import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from brute import ODD
from parapet.llm import hyperlang, ppm, quality
from parapet.llm.blocks import hashes, mix
from pyspark.sql import functions as F


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


class PlainPpm:
    """Method D with symbol exclusion, straight from the counts of every order."""

    def __init__(self, texts, order):
        self.order = order
        self.seen = [defaultdict(Counter) for _ in range(order + 1)]
        for text in texts:
            data = b"\xff" * order + brute.lower(text).encode() + b"\xff"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.seen[k][data[i - k:i]][data[i]] += 1

    def score(self, text):
        data = b"\xff" * self.order + brute.lower(text).encode() + b"\xff"
        return sum(self.code(data[:i], data[i]) for i in range(self.order, len(data)))

    def code(self, before, symbol):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            here = {s: c for s, c in self.seen[k].get(before[len(before) - k:], {}).items() if s not in excluded}
            if not here:
                continue
            total = sum(here.values())
            if symbol in here:
                return out + math.log10((here[symbol] - 0.5) / total)
            out += math.log10(len(here) / (2 * total))
            excluded |= set(here)
        return out - math.log10(256 - len(excluded))


def test_ppm_and_base_equal_plain_versions(spark, make, sample):
    rows = sample[:60] + [r for r in ODD if len(r[1] or "") < 3_000]
    rows += [(70_000 + i, "solo%d THE end" % i) for i in range(30)]
    train = [t for i, t in rows if fold(i, 7) != 2]
    plain = PlainPpm(train, ppm.ORDER)
    counts = Counter(w for t in train for w in [*brute.SPACED.findall(brute.lower(t)), None])
    total, kinds = sum(counts.values()), len(counts)
    want = {}
    for i, t in rows:
        words = [*brute.SPACED.findall(brute.lower(t)), None]
        want[str(i), t] = (
            fold(i, 7) == 2, len(words), sum(counts[w] > 0 for w in words), total,
            sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words), plain.score(t))
    for hot in (1 << 20, 20):  # all words travel; nearly all are joined
        got = ppm.scored(make(rows, extra=True), hot_words=hot).collect()
        assert len(got) == len(rows)
        texts = defaultdict(list)
        for i, t in rows:
            texts[str(i)].append(t)
        for r in got:
            for_row = want[str(r.doc_id), texts[str(r.doc_id)][0]]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == for_row[:4]
            assert r.base_score == pytest.approx(for_row[4], rel=1e-9)
            assert r.score == pytest.approx(for_row[5], rel=1e-5)


def test_ppm_without_training_and_with_a_small_trie(spark, make, sample):
    lone = next(i for i in range(100) if fold(i, 7) == 2)
    got = ppm.scored(make([(lone, "ab")])).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens) == (2, 0, 0)
    assert got.score == pytest.approx(-3 * math.log10(256))
    assert ppm.scored(make([])).count() == 0
    small = ppm.scored(make(sample), capacity=2_000).collect()
    assert len(small) == len(sample) and all(r.score < 0 for r in small)


def test_ppm_score_does_not_depend_on_what_travels(spark, make, sample):
    rows = sample[:40] + [r for r in ODD if len(r[1] or "") < 300]
    rows += [(80_000 + i, "qu\u00e9 \u4f60\u597d %dxq" % (i * 7919)) for i in range(20)]
    plain = PlainPpm([t for i, t in rows if fold(i, 7) != 2], ppm.ORDER)
    want = sorted((str(i), plain.score(t)) for i, t in rows)
    for capacity in (2_000, 0):
        got = sorted((str(r.doc_id), r.score) for r in ppm.scored(make(rows), capacity=capacity, hot_words=20).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-5)


def test_probabilities_sum_to_one(sample):
    keys = ppm.grams(*ppm.padded(block(["abracadabra abracadabra", "banana"])))
    trie = ppm.compile_trie(*np.unique(keys, return_counts=True))
    for context in (b"\xff" * 5, b"\xffabra", b"cadab", b"zzzzz", b"xanan"):
        base = int.from_bytes(context, "big") << 8
        logs = ppm.code(trie, np.array([base + s for s in range(256)], np.uint64))
        assert (10.0 ** logs).sum() == pytest.approx(1, abs=1e-5)


def block(texts):
    import pyarrow as pa
    from parapet.llm.blocks import blocks

    return next(blocks([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))


def test_languages_on_the_held_out_fold(spark):
    from parapet.llm.queries import op8_hyperdimensional

    folder = "/root/testdata/sf0.01"
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in op8_hyperdimensional(spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_cases(spark, make, sample):
    rows = ODD + [(1, "1234 !!"), (2, "abc abd abe " * 30), (3, "a"), (4, "1b"), (5, "你")]
    got = hyperlang.identified(make(rows, extra=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[10_001] == by[10_002] == by[10_003] == by[1] == ("und", 0.0)
    assert by[3][0] == by[4][0] == by[5][0] == "en"  # a single letter is enough
    assert by[2][0] == "en" and by[10_009][0] == "en"
    nothing = hyperlang.identified(make(rows).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert hyperlang.identified(make([])).count() == 0


def plain_bundle(text):
    """Sum of the bound, permuted letter vectors of every triple with a letter."""
    letters = [ord(c.lower()[:1]) if c.lower()[:1].isalpha() else 0 for c in f" {text or ''} "]
    out = np.zeros(hyperlang.DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if a or b or c:
            one, two, three = hyperlang.letter_vectors(np.array([a, b, c]))
            out += np.roll(one, 2) * np.roll(two, 1) * three
    return out


def test_languages_equal_the_plain_version(spark, make, sample, monkeypatch):
    rows = [(i, (t or "")[:400]) for i, t in sample[:60]] + [r for r in ODD if len(r[1] or "") < 500]
    rows += [(100 + i, "你好世界 再见 çé ß" + chr(0x4E00 + i) * 2) for i in range(9)]
    lang = {i: ("zh" if 100 <= (i or 0) < 109 else "en") for i, _ in rows}
    docs = make(rows).withColumn("lang", F.when(F.col("doc_id").between(100, 108), "zh").otherwise("en"))
    learned = {k: sum(plain_bundle(t) for i, t in rows if lang[i] == k and fold(i, 3) != 1) for k in ("en", "zh")}
    want = []
    for i, t in rows:
        own = plain_bundle(t)
        cosines = [own @ v / np.linalg.norm(v) / (np.linalg.norm(own) or 1) for v in learned.values()]
        known = any(c.isalpha() for c in t or "")
        want.append((str(i), fold(i, 3) == 1, list(learned)[int(np.argmax(cosines))] if known else "und",
                     round(max(max(cosines), 0.0), 5) if known else 0.0))
    got = hyperlang.identified(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 5)) for r in got) == sorted(want)


def test_bundles_do_not_depend_on_slices(monkeypatch):
    texts = ["".join(chr(0x4E00 + (i * i) % 997) + ("a" if i % 3 else " ") for i in range(900)), "ab", "", "你"]
    whole, count = hyperlang.bundled(block(texts))
    assert (whole == [plain_bundle(t) for t in texts]).all() and count.tolist()[1:] == [2, 0, 1]
    monkeypatch.setattr(hyperlang, "SLICE", 100)
    monkeypatch.setattr(hyperlang, "KINDS", 7)
    assert (hyperlang.bundled(block(texts))[0] == whole).all()


def test_held_out_texts_do_not_change_profiles(spark, make):
    rows = [(i, f"abc{chr(97 + i % 20)} def " * 20) for i in range(40)]
    other = [(i, "zzz yyy xxx" if fold(i, 3) == 1 else t) for i, t in rows]
    one, two = (hyperlang.profiles(hyperlang.with_fold(make(r).select("doc_id", "text", "lang"))) for r in (rows, other))
    assert all((one[k] == two[k]).all() for k in one) and one.keys() == two.keys()


def test_quality_on_the_held_out_fold(spark):
    from parapet.llm.queries import op5_random_indexing

    folder = "/root/testdata/sf0.1"
    label = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()}
    got = [r for r in op5_random_indexing(spark, folder).collect() if r.held_out and r.doc_id in label]
    good = np.array([label[r.doc_id] for r in got])
    score = np.array([r.score for r in got])
    rank = score.argsort().argsort()
    area = (rank[good == 1].mean() - rank[good == 0].mean()) / len(got) + 0.5
    assert area > 0.99 and ((score >= 0.3) == good).mean() > 0.97
    assert -np.mean(np.log(np.where(good == 1, score, 1 - score) + 1e-9)) < 0.08  # calibrated


def test_quality_cases(spark, make):
    rows = ODD + [(i, f"plain words number {i} here") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (None, 1), (5, None)],
                                   "doc_id long, quality int")
    got = quality.rated(make(rows, extra=True), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    assert {r.held_out == (fold(r.doc_id, 5) == 0) for r in got} == {True}
    twins = [r.score for r in got if r.doc_id == 10_008]
    assert twins[0] == twins[1]
    none = quality.rated(make(rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.rated(make([]), labels).count() == 0


def plain_words(text):
    """Form hash and shape of each run of letters and digits, or of signs."""
    out = []
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (text or "").encode()):
        form = hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        upper, digit = re.search(rb"[A-Z]", w) is not None, re.search(rb"[0-9]", w) is not None
        sign = re.match(rb"[0-9A-Za-z\x80-\xff]", w) is None
        cased = 3 if re.fullmatch(rb"[A-Z]+", w) else 2 if w[:1].isupper() else int(upper)
        out.append((form, min(len(w), 15) * 16 + sign * 8 + digit * 4 + cased))
    return out


def test_word_vectors_and_pools_equal_plain_versions(spark, make, sample):
    rows = [(i, (t or "")[:300]) for i, t in sample[:40]] + [r for r in ODD if len(r[1] or "") < 300]
    rows += [(5, "A1b2 ... CAPS x-y"), (6, "one"), (7, "  two  words ")]
    sums = defaultdict(lambda: np.zeros(quality.DIMENSIONS))
    index = lambda v: [(int(p[0]), int(s[0])) for p, s in quality._index(np.array([v], np.uint64))]
    places = lambda w: (int(w[0]) >> (64 - quality.SLOT_BITS), quality.SLOTS + w[1])
    for _, t in rows:
        own = plain_words(t)
        marks = [index(f) + index(mix(np.array([s], np.uint64) + np.uint64(0xABCDEF))[0]) for f, s in own]
        for i, w in enumerate(own):
            for j in range(max(i - 2, 0), min(i + 3, len(own))):
                for at, sign in marks[j] if j != i else ():
                    for place in places(w):
                        sums[place][at] += sign
    table = quality.word_vectors(make(rows))
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    for place, total in sums.items():
        assert table[place] == pytest.approx(unit(total), abs=1e-6)
    assert {int(i) for i in np.flatnonzero(np.abs(table).sum(1))} <= set(sums)
    pools = quality.pooled(block([t or "" for _, t in rows]), table)
    for (_, t), pool in zip(rows, pools):
        own = plain_words(t)
        if not own:
            assert not pool.any()
            continue
        want = []
        for kind in (0, 1):
            vectors = np.array([unit(sums[places(w)[kind]]) for w in own])
            want += [*vectors.mean(0), *vectors.std(0)]
        distinct = len({f for f, _ in own})
        want += [np.log1p(len(own)), distinct / len(own), np.log1p(distinct) / np.log1p(len(own))]
        assert pool == pytest.approx(np.array(want), abs=2e-3)


def test_a_repeated_labelled_id_stays_in_bounds(spark, make, monkeypatch):
    rows = [(i, f"text of {i}") for i in range(30)] + [(3, "text of 3")] * 40 + [(4, f"other {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    docs = make(rows)
    name = quality.ship(spark, "vectors", {"vectors": quality.word_vectors(docs)})
    x, y = quality.training_rows(docs, labels, name, 1000)
    learned = [(i, t) for i, t in set(rows) if fold(i, 5)]
    assert len(x) == len(y) == len(learned) and y.sum() == sum(i % 2 for i, _ in learned)
    assert len(quality.training_rows(docs, labels, name, 12)[0]) <= 12
