"""Secret scans: fixed patterns, and tokens that look random under character models.

Everything is a column expression; no Python runs on the executors.

A pattern's matches are found by cutting the text at them: the pieces between and the
matches in turn give every position. Two first-order Markov models over letters and digits
are trained on labelled samples of the corpus, one on what the patterns find (random
strings), one on all other runs of letters and digits (ordinary words, numbers, parts of
paths), both smoothed with one count per pair and mixed with a share ``UNKNOWN`` of equal chances,
so that a few pairs which the corpus lacks do not outweigh a whole name. Separators end a run, in training and in
scans: ordinary names differ too much in them. A token of 20 characters or more that holds
a digit and a letter, lies outside all pattern matches and whose mean log-likelihood ratio
per pair exceeds ``margin`` is a further span. The samples come from about ``SAMPLE_ROWS`` documents chosen
by hash; every text is scanned whole.

Defined cases: a null text is an empty one and has no spans; touching spans stay apart;
repeated rows are scanned alike; other columns pass through. Positions of many matches are
counted in pieces and overlaps found by binary search, so the scan of one text does not grow
with the square of its tokens. Without any labelled sample
the smoothed models are equal and no span is added.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, functions as F

from parapet.functions.once import bind, computed

#: Kinds, patterns, and the least length of the tested part.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGN = 8
KINDS = ("assign", "access", "hex", "markov")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
RUN = r"[A-Za-z0-9]{2,}"
SAMPLE_ROWS = 10_000
UNKNOWN = 0.1
MARGIN = 0.35
MASK = "[SECRET]"


def _ranges(text: Column, pattern: str, group: int = 0, possible: Column | None = None) -> Column:
    """Matches in order as (start, end, group length), in code points. ``possible`` is a
    cheap test that holds wherever the pattern matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(
        F.slice(between, 1, F.size(found)), F.arrays_zip(found.alias("a"), tested.alias("b")),
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"), F.length(match["a"]).alias("long"),
            F.length(match["b"]).alias("tested")))
    none = F.array().cast("array<struct<start:int,end:int,tested:int>>")
    walked = lambda chunk: F.aggregate(
        chunk, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda done, m: F.struct(
            (done["at"] + m["gap"] + m["long"]).alias("at"),
            F.array_append(done["out"], F.struct(
                (done["at"] + m["gap"]).alias("start"),
                (done["at"] + m["gap"] + m["long"]).alias("end"),
                m["tested"].alias("tested"))).alias("out")))
    return F.when(text.rlike(pattern) if possible is None else possible,
                  bind(bind(lengths, lambda m: F.transform(_chunks(m), walked)), _placed)).otherwise(none)


def _chunks(items: Column) -> Column:
    """An array in pieces of about the root of its size, 64 at least. Folds that append
    copy what they have, so they run over a piece, and over the pieces."""
    width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items))).cast("int"))
    last = ((F.size(items) - 1) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * width + 1, width))


def _placed(pieces: Column) -> Column:
    """Ranges of all pieces, moved by the lengths of the pieces before."""
    offsets = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda done, p: F.struct(
            (done["at"] + p["at"]).alias("at"), F.array_append(done["out"], done["at"]).alias("out")),
        lambda done: done["out"])
    return F.flatten(F.zip_with(pieces, offsets, lambda p, by: F.transform(p["out"], lambda r: F.struct(
        (r["start"] + by).alias("start"), (r["end"] + by).alias("end"), r["tested"].alias("tested")))))


def _kind(ranges: Column, kind: str) -> Column:
    return F.transform(ranges, lambda r: F.struct(
        r["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), r["end"].alias("end")))


def base_spans(text: Column, long_token: Column) -> dict[str, Column]:
    """Ranges of the three fixed kinds; matches that are too short are dropped. A hex run
    of the wanted length always lies in a long token."""
    assign = F.filter(_ranges(text, ASSIGN, 2, text.contains(":") | text.contains("=")),
                      lambda r: r["tested"] >= LEAST_ASSIGN)
    return {"assign": _kind(assign, "assign"),
            "access": _kind(_ranges(text, ACCESS, possible=text.contains("AKIA")), "access"),
            "hex": _kind(_ranges(text, HEX, possible=long_token), "hex")}


def samples(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``random, token``: labelled samples from about ``rows`` documents chosen by hash."""
    share = min(1.0, rows / max(docs.count(), 1))
    level = min(int((2 * share - 1) * 2.0 ** 63), 2 ** 63 - 1)
    chosen = docs.filter(F.xxhash64("text", F.lit("sample")) <= F.lit(level)).select("text")
    assign = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
    exact = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (ACCESS, HEX)])
    outside = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        outside = F.regexp_replace(outside, pattern, " ")
    plain = F.regexp_extract_all(outside, F.lit(RUN), F.lit(0))
    return chosen.select(F.explode(F.concat(
        F.transform(F.filter(assign, lambda t: F.length(t) >= LEAST_ASSIGN),
                    lambda t: F.struct(F.lit(True).alias("random"), t.alias("token"))),
        F.transform(exact, lambda t: F.struct(F.lit(True).alias("random"), t.alias("token"))),
        F.transform(plain, lambda t: F.struct(F.lit(False).alias("random"), t.alias("token"))),
    )).alias("s")).select("s.*").filter(F.length("token") > 1)


def ratios(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair, random over ordinary.

    The counts are at most two per pair of the alphabet, so they are few at any input.
    """
    pairs = labelled.select("random", F.explode(bind(
        F.split("token", ""), lambda c: F.zip_with(
            F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b)))).alias("pair"))
    counts = {(r, p): n for r, p, n in pairs.groupBy("random", "pair").count().collect()
              if all(c in ALPHABET for c in p)}
    out, size = [], len(ALPHABET)
    totals = {(r, a): sum(counts.get((r, a + b), 0) for b in ALPHABET) for r in (True, False) for a in ALPHABET}
    for a in ALPHABET:
        for b in ALPHABET:
            p, q = ((1 - UNKNOWN) * (counts.get((r, a + b), 0) + 1) / (totals[r, a] + size) + UNKNOWN / size
                    for r in (True, False))
            out.append(math.log(p / q))
    return out


def _mean_ratio(token: Column, weights: Column) -> Column:
    size = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = bind(codes, lambda c: F.filter(
        F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1),
                   lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: (p["a"] >= 0) & (p["b"] >= 0)))
    total = lambda own: F.aggregate(
        own, F.lit(0.0), lambda s, p: s + F.get(weights, p["a"] * size + p["b"]))
    return bind(pairs, lambda own: F.when(F.size(own) > 0, total(own) / F.size(own)).otherwise(0.0))


def _meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether a range overlaps one of the sorted and disjoint spans, by binary search."""
    steps = F.ceil(F.log2(F.size(spans) + 1)).cast("int")

    def halved(at: Column, step: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        before = F.coalesce(F.get(spans, middle)["start"] < end, F.lit(False))
        live = at["low"] < at["high"]
        return F.struct(F.when(live & before, middle + 1).otherwise(at["low"]).alias("low"),
                        F.when(live & ~before, middle).otherwise(at["high"]).alias("high"))

    below = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halved,
        lambda at: at["low"])
    return F.coalesce(F.get(spans, below - 1)["end"] > start, F.lit(False))


def scan(docs: DataFrame, margin: float = MARGIN, text: str = "text",
         sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with ``base_spans`` and ``all_spans`` (which replace columns of these
    names): arrays of (start, kind, end)
    sorted by start, then kind as listed in ``KINDS``; ends are exclusive code points."""
    learned = ratios(samples(docs.select(F.col(text).alias("text")), sample_rows))
    weights = F.expr("cast(split('" + ",".join(f"{w:.6f}" for w in learned) + "', ',') as array<double>)")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("own"))
    own, long_token = F.col("own"), F.col("long_token")
    marked = computed(rows, long_token=own.rlike(TOKEN))
    tokens = F.zip_with(
        _ranges(own, TOKEN, possible=long_token),
        F.when(long_token, F.regexp_extract_all(own, F.lit(TOKEN), F.lit(0))).otherwise(F.array()),
        lambda r, t: F.struct(r["start"].alias("start"), r["end"].alias("end"), t.alias("token")))
    with_base = computed(
        marked, **base_spans(own, long_token),
        tokens=F.filter(tokens, lambda t: t["token"].rlike("[0-9]") & t["token"].rlike("[A-Za-z]")))
    base = KINDS[:-1]
    extra = F.filter("tokens", lambda t: ~functools.reduce(
        operator.or_, [_meets(F.col(kind), t["start"], t["end"]) for kind in base])
        & (_mean_ratio(t["token"], weights) > margin))
    spans = computed(with_base, base_spans=F.array_sort(F.concat(*base)),
                     all_spans=F.array_sort(F.concat(*base, _kind(extra, "markov"))))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("base_spans", "all_spans")]
    return spans.select(*kept, "base_spans", "all_spans")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter(
        "base_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("all_spans")).alias("spans"))


def _gaps(spans: Column) -> Column:
    """The ranges (start, end) between the end of all spans before and the next span."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    walked = lambda chunk: F.aggregate(
        chunk, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.array_append(done["out"], F.struct(done["at"].alias("start"), s["start"].alias("end"))).alias("out")))

    def placed(pieces: Column) -> Column:
        reached = F.aggregate(
            pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda done, p: F.struct(F.greatest(done["at"], p["at"]).alias("at"),
                                     F.array_append(done["out"], done["at"]).alias("out")),
            lambda done: done["out"])
        return F.filter(F.flatten(F.zip_with(pieces, reached, lambda p, at: F.transform(
            p["out"], lambda g: F.struct(F.greatest(g["start"], at).alias("start"), g["end"].alias("end"))))),
            lambda g: g["start"] <= g["end"])

    return bind(F.transform(_chunks(spans), walked), placed)


def _cut(text: Column, spans: Column, mask: str) -> Column:
    """The text with a mask for each run of overlapping spans; there is one at least."""
    def pieces(chunk: Column) -> Column:
        base = F.get(chunk, F.lit(0))["start"]
        part = F.substr(text, base + 1, F.element_at(chunk, -1)["end"] - base)
        return bind(part, lambda own: F.transform(
            chunk, lambda g: F.substr(own, g["start"] - base + 1, g["end"] - g["start"])))

    kept = F.array_join(F.flatten(F.transform(bind(_gaps(spans), _chunks), pieces)), mask)
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(kept, F.lit(mask), F.substr(text, end + 1, F.lit(2 ** 31 - 1)))


def masked(docs: DataFrame, mask: str = MASK, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The documents with every span replaced by ``mask``; texts without one stay as they
    are, nulls among them. ``n_chars`` follows the text where the column exists; all other
    columns stay, whatever their names."""
    scanned = scan(docs.select(F.struct("*").alias("document"), F.col(text).alias("text")), margin)
    hit = F.size("all_spans") > 0
    changed = computed(scanned, text=F.when(
        hit, _cut(F.col("text"), F.col("all_spans"), mask)).otherwise(F.col("text")), hit=hit)
    out = {c: F.col("document").getField(c) for c in docs.columns}
    out[text] = F.col("text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
            out["n_chars"])
    return changed.select(*[value.alias(name) for name, value in out.items()])
