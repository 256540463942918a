"""Slow, plain versions of the operators for small fixtures."""

import hashlib
import re
from itertools import combinations

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def windows(words, n):
    return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]


def quality(text, shortest):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    triples = windows(words, 3)
    hit = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    longest = [0] * len(words)
    for i, j in combinations(range(len(words)), 2):
        k = 0
        while j + k < len(words) and words[i + k] == words[j + k]:
            k += 1
        if k >= shortest:
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    covered = {i + k for i, n in enumerate(longest) for k in range(n)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup,
        "n_repeat_words": len(hit), "covered_words": len(covered),
        "longest_repeat": max(longest, default=0)}


def contaminated(text, items, n=10):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = ALNUM.findall(lower(body))
        for w in set(windows(own, min(n, len(own)))) if own else ():
            for i, v in enumerate(windows(words, len(w))):
                if v == w:
                    found.add("null" if item is None else str(item))
                    hit.update(range(i, i + len(w)))
    return len(words), len(hit), len(found), sha(",".join(sorted(found)))


def shingle_set(text, n):
    words = SPACED.findall(lower(text))
    return set(windows(words, n)) if len(words) >= n else ({tuple(words)} if words else set())


def near(rows, n, percent):
    """rows: (id, text) with distinct ids. id -> (set size, component)."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small and 100 * small >= percent * large:
            same = len(sets[a] & sets[b])
            if 100 * same >= percent * (small + large - same):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


RULES = (
    ("assign", re.compile(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def secrets(text):
    spans = sorted((m.start(), k, m.end(), kind) for k, (kind, rule, group, least) in enumerate(RULES)
                   for m in rule.finditer(text or "") if len(m.group(group)) >= least)
    return {kind: sum(s[3] == kind for s in spans) for kind, *_ in RULES}, [
        f"{kind}:{a}:{b}" for a, _, b, kind in spans]


#: Documents (id, text) that every operator must stand.
ODD = [(10_001, None), (10_002, ""), (10_003, " \n\t "), (10_004, "one"), (10_005, "One two"),
       (None, "a null id has words " * 20), (10_006, "x" * 300_000), (10_007, "same word " * 4_000),
       (10_008, "tie tie tie"), (10_008, "tie tie tie"), (10_009, "é ß 你好 字 \x1c ok"),
       (10_010, "LINE one\nline two\nLINE one\n\n\nLINE one")]
