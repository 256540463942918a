import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from brute import ODD
from parapet.llm import balltree, chat, variants

# -- spelling variants --------------------------------------------------------------------

LOWER = str.maketrans(variants.UPPER, variants.UPPER.lower())


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def plain_variants(rows):
    counts = plain_words(rows)
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: best[w] if w in best and counts[best[w]] >= 5 * counts[w] else None for w in counts}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, str(form[w]), root(w), counts[w], len(near[w]), str(counts.get(form[w]))) for w in counts)


def got_variants(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def edited(rng, word, letters):
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + ("" if kind == 0 else rng.choice(letters)) + word[at + (kind < 2):]


def test_variants_equal_brute_force(spark, make, sample):
    rng = random.Random(11)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 12))) for _ in range(40)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "Éÿ" * 50, "z" * 90, "z" * 91]
    pool = base + [edited(rng, rng.choice(base), "abéz") for _ in range(300)]
    rows = [(70_000 + i, " ".join(rng.choices(pool, k=80)) + " " + base[i % 3]) for i in range(300)]
    rows += [(80_000 + i, " ".join(["common"] * 40 + ["comon"] * 5 + ["commoner"])) for i in range(6)]
    rows += list(sample[:60]) + ODD + ODD + [(1, "LONG" * 3_000)] * 5
    assert got_variants(variants.grouped(make(rows, extra=True))) == plain_variants(rows)
    assert variants.grouped(make([])).count() == 0


def test_full_buckets_are_cut_into_blocks(spark):
    """More words in one bucket than a block has, and words too long for one tile."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"abcd{x}{y}", 5 + (ord(x) * 7 + ord(y)) % 50) for x in letters for y in letters]
    rows += [("w" * 4_000 + x + y, 6 + ord(x) % 5) for x in letters[:6] for y in letters[:3]]
    counts = dict(rows)
    words = spark.createDataFrame(rows, "word string, n long")
    got = {r.word: (r.n_near, r.best, r.best_n) for r in variants.near_words(words).collect()}
    for w in counts:
        near = [x for x in counts if x[:4] == w[:4] and one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x))
        assert got[w] == (len(near), best, counts[best])


# -- chat ---------------------------------------------------------------------------------

TURNS = "turn long, conv_id long, role string, text string, segments string, learned string, turns string"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s> \\ [\\\\NEXT] <<s> [[END]", "", None, "a\nb", "é <</SYS>> <", "[", "\\"]


def plain_digest(rows):
    out, lone = {}, 0
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        lone += conv is None
        out.setdefault((conv, lone if conv is None else 0), []).append((role or "", text or ""))
    return sorted((str(conv), len(t), brute.sha("".join(f"{r}\n{x}\n" for r, x in t)),
                   sum(len(x) for r, x in t if r == "assistant"),
                   brute.sha("".join(x for r, x in t if r == "assistant"))) for (conv, _), t in out.items())


def conversations(spark, rows):
    return spark.createDataFrame([(t, c, r, x, "a", "b", "c") for c, t, r, x in rows], TURNS)


def test_conversations_come_back(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "assistant", "tool", None, "[/ROLE]", "<\\s>"]
    rows = [(c, t, rng.choice(roles), rng.choice(NASTY)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "assistant", "alone")] * 3 + [(500, None, "user", "first"), (500, 1, "assistant", "x" * 200_000)]
    rows += [(501, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(3_000)]
    output = chat.formatted(conversations(spark, rows))
    got = chat.digest(chat.read_back(output)).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == plain_digest(rows)
    for r in output.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
    assert chat.formatted(conversations(spark, [])).count() == 0


def test_marks_and_merging(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "</s>"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c")]
    out = chat.formatted(conversations(spark, rows)).first()
    assert out.formatted == "[INST]a[NEXT]<\\/s>[/INST]<s>b[NEXT]c</s>"
    assert [s.text for s in out.segments if s.loss] == ["b", "c"]


def test_repeated_rows_are_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a")]
    assert chat.digest(chat.read_back(chat.formatted(conversations(spark, rows)))).first().n_turns == 2


# -- ranked search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranking(rows, items):
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score:
                scored.append((-score, i is None, i or 0))
        out += [(str(item), k + 1, None if lone else i, -s) for k, (s, lone, i) in enumerate(sorted(scored)[:10])]
    return sorted(out, key=str)


ITEMS = [(1, "one two THREE three"), (1, "tie"), (2, None), (3, "..."), (None, "same word LINE"), (4, "é 你好 x1"),
         (5, "null id has words"), (5, "null id has words")]


def as_rows(df):
    return sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_terms", [1 << 16, 30])
def test_ranking_equals_brute_force(spark, make, sample, block_terms):
    rows = list(sample) + ODD + [(20_000 + i, "tie " * (1 + i % 3) + "one") for i in range(40)]
    items = spark.createDataFrame([(t, "x", i, 1) for i, t in ITEMS + [(100 + i, t) for i, t in sample[:12]]],
                                  "text string, score string, item_id long, doc_id int")
    got = balltree.ranked(make(rows, extra=True), items, block_terms=block_terms)
    assert as_rows(got) == plain_ranking(rows, ITEMS + [(100 + i, t) for i, t in sample[:12]])


def test_nothing_to_rank(spark, make):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert balltree.ranked(make([]), items).count() == 0
    assert balltree.ranked(make([(1, "b"), (2, None)]), items).count() == 0
    assert balltree.ranked(make([(1, "a")]), items.limit(0)).count() == 0


def grown_tree(rng, topics, docs):
    """Documents of one of several topics each; items of eight terms of a topic."""
    import pyarrow as pa

    size, asked = 40 * topics, [(i, 40 * (i % topics) + k) for i in range(30) for k in rng.sample(range(40), 8)]
    table = pa.table({"item_id": [i for i, _ in asked], "item_hash": [0] * len(asked),
                      "term": [t for _, t in asked], "times": [1 + t % 2 for _, t in asked]})
    held = [sorted(40 * (d % topics) + k for k in rng.sample(range(40), 12)) for d in range(docs)]
    known = sorted({t for _, t in asked})
    df = Counter(t for h in held for t in h)
    frequency = pa.table({"term": list(range(len(known))), "df": [df[t] for t in known]})
    items = balltree.Items(table, frequency, docs)
    held = [[known.index(t) for t in h if t in df and t in known] for h in held]
    cuts = np.cumsum([0] + [len(h) for h in held])
    impact = np.array([400_000 + 1_000 * (i * 7 % 90) for i in range(int(cuts[-1]))], np.int64)
    term = np.array([t for h in held for t in h], np.int64)
    return size, items, balltree.Tree(term, impact, cuts, items, leaf=8)


def test_bounds_hold_and_subtrees_stay_closed():
    _, items, tree = grown_tree(random.Random(3), 10, 600)
    every = np.zeros((600, len(items.first)), np.int64)
    for node, rows in enumerate(tree.rows):
        if not tree.children[node]:
            for item in range(len(items.first)):
                every[rows, item] = tree.scores(node, item)
    for node, rows in enumerate(tree.rows):
        assert (tree.bound[node] >= every[rows].max(0)).all()
    scored = 0
    for item in range(len(items.first)):
        best = balltree.Best(10)
        best.ids = list(range(600))
        scored += tree.search(item, best)
        want = sorted((-int(s), False, d) for d, s in enumerate(every[:, item]) if s)[:10]
        assert best.held == want
    assert scored < 0.5 * every.size


def test_long_documents_of_many_documents_do_not_overflow():
    n, documents, total = np.array([9_000_000]), 10**11, 3 * 10**13
    assert balltree.impacts(np.array([7]), n, documents, total)[0] == (
        7 * 10**9 // (7000 + 8 * (25 + 75 * 9_000_000 * documents // total)))


def test_digest_of_ranking_is_stable(spark, make):
    rows = [(i, "w" * (i % 7) + " same") for i in range(50)]
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    digests = {hashlib.sha256(str(as_rows(balltree.ranked(make(rows).repartition(p), items))).encode()).hexdigest()
               for p in (1, 5)}
    assert len(digests) == 1
