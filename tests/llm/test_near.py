import random

import brute
from brute import ODD
from parapet.llm import hyperminhash
from parapet.llm.connect import components
from parapet.llm.hyperminhash import Similarity


def grouped(docs, like):
    return {r.doc_id: (r.n_shingles, r.component_id)
            for r in hyperminhash.near_groups(docs, like).collect() if r.doc_id is not None}


def chain(seed, length, size, step):
    """Texts of which neighbours are alike and far ones are not."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**9)}" for _ in range(size + length * step)]
    return [" ".join(words[i * step:i * step + size]) for i in range(length)]


def test_components_equal_brute_force(spark, make, sample):
    rng = random.Random(7)
    base = [f"b{rng.randrange(10**6)}" for _ in range(80)]
    rows = list(sample) + [r for r in {i: (i, t) for i, t in ODD if i is not None}.values()]
    for i in range(150):  # a large group of near copies, many just at the threshold
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((60_000 + i, " ".join(own)))
    rows += [(61_000 + i, t) for i, t in enumerate(chain(3, 30, 120, 3))]
    rows += [(62_000, "A b c d e f g h"), (62_001, "a B c d e f g h"), (62_002, "b")]
    for words, percent in ((3, 85), (5, 80)):
        want = brute.near(rows, words, percent)
        got = grouped(make(rows, extra=True), Similarity(words, percent))
        assert got == want


def test_null_and_repeated_rows(spark, make):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)]
    got = hyperminhash.near_groups(make(rows), Similarity(3, 85)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "None", True), ("None", "None", True)]
    kept = hyperminhash.drop_near_copies(make(rows, extra=True), Similarity(3, 85))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None", "None"]
    assert kept.columns == make(rows, extra=True).columns
    assert hyperminhash.near_groups(make([])).count() == 0


def test_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**63, 1150, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        a, b = np.sort(pool[:1075]), np.sort(pool[75:])
        true = 1000 / 1150
        errors.append(hyperminhash.estimate(
            hyperminhash.registers(a)[None], hyperminhash.registers(b)[None],
            np.array([1075]), np.array([1075]))[0] - true)
    assert abs(np.mean(errors)) < 0.02


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (9, 9)], "u long, v long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[500] == got[501] == 500
    assert components(edges.limit(0)).count() == 0


def test_interleaved_families_in_narrower_groups(spark, make, monkeypatch):
    """Two families with one base each and a shared passage, most members just below the
    threshold, and groups that are all too large for one task at first."""
    monkeypatch.setattr(hyperminhash, "PER_GROUP", 6)
    rng = random.Random(13)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(60)]
    bases = [shared + [f"{name}{rng.randrange(10**6)}" for _ in range(40)] for name in "pq"]
    rows = []
    for i in range(160):
        own = list(bases[i % 2])
        for _ in range(rng.choice((0, 1, 2, 4, 5, 6, 7, 8))):
            own[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((90_000 + i, " ".join(own)))
    assert grouped(make(rows), Similarity(3, 85)) == brute.near(rows, 3, 85)


def test_rows_repeated_many_times(spark, make):
    rows = [(1, "one two three four five six")] * 40 + [(2, "one two three four five six")] * 40 + [(3, "else " * 9)]
    assert grouped(make(rows), Similarity(3, 85)) == {1: (4, 1), 2: (4, 1), 3: (1, 3)}


def test_chance_of_missing_a_pair_by_width():
    like = Similarity(words=5, percent=80)
    for width, most in ((8, 1e-6), (12, 1e-6), (16, 1e-6), (24, 0.01)):
        assert (1 - 0.8 ** width) ** hyperminhash.keys_for(width, like) < most
    assert hyperminhash.keys_for(128, like) == 1
